"""Packing by power-of-two decomposition.

A document of n tokens is cut into full sequences of 2048 and then the binary digits of what is left, longest first. Pieces of
equal length form a bucket, and each piece is a sequence of its own: no sequence crosses documents, and as every length is a
power of two none is padded. Sequence ids number the buckets' pieces without gaps, longest bucket first: each task counts its
pieces by length, and prefix sums over the tasks' totals say where its numbers begin, so that no piece is shuffled.

Token ids are those of the tokenizer file; they are looked up by white-space-separated word, since that tokenizer drops white space
before anything else. Defined results: a null or empty text has the closing id alone, one piece of length 1; repeated
rows give repeated pieces with sequences of their own; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

MOST = 2048
END = 1
#: Tasks whose totals are summed together, before those of all such groups are.
GROUP = 1024
#: Stems whose ids a worker keeps before it begins anew, and from how many characters on words aren't kept.
KNOWN_WORDS, LONGEST_WORD = 700_000, 64
#: Bytes of the texts whose words are looked up together.
AT_ONCE = 6_000_000
BETWEEN, WORD_END = "<|endoftext|>", "</w>"
#: Punctuation that the tokenizer never joins with a letter before it; the apostrophe isn't of this kind.
TAIL = '.,;:!?%*&$#|)("-_/\\@=+<>[]{}~^`'
#: Lower-case letters that no normalisation changes. A run of them, less the punctuation after it, is one word of the tokenizer.
PLAIN = "^[" + "".join(c for c in map(chr, range(0x250)) if c.isalpha() and c.lower() == c and unicodedata.normalize("NFC", c) == c) + "]+$"
#: Where a text holds a blank other than these four, it is cut at these only: not all libraries agree on the others.
BLANK, ODD_BLANK = re.compile("[ \n\r\t]+"), "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def pieces(n: int, most: int = MOST) -> list[tuple[int, int]]:
    """(start, length) of the cuts of n tokens."""
    out, at = [], 0
    while n - at >= most:
        out.append((at, most))
        at += most
    bit = most
    while bit := bit >> 1:
        if (n - at) & bit:
            out.append((at, bit))
            at += bit
    return out


class Ids:
    """Little-endian ids of texts, by distinct words; a word is a stem and the punctuation that ends it, and stems are kept.

    Stems of plain letters go to the model without the tokenizer's normalisation, many at once, since each gives one run of ids
    that closes with a word end; where the runs don't match the stems, and for all other words, the whole tokenizer decides.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocab.values()) + 1, bool)
        self.closes[[i for w, i in vocab.items() if w.endswith(WORD_END)]] = True
        self.known: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> list[bytes]:
        """By the whole tokenizer, with a special token between the words."""
        one = self.tokenizer.encode_batch_fast([BETWEEN.join(words)], add_special_tokens=False)[0]
        ids = np.array(one.ids, "<u4")
        ends = np.flatnonzero(ids == self.between)
        if self.between is None or len(ends) != len(words) - 1:  # a word holds the special token itself
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        raw, cuts = ids.tobytes(), (ends * 4).tolist()
        return [raw[i:j] for i, j in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)]

    def encode_plain(self, words: list[str]) -> list[bytes]:
        """Of words that are runs of PLAIN letters."""
        ids = np.array(self.bare.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        cuts = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
        if len(cuts) != len(words) or cuts[-1] != 4 * len(ids):
            return self.encode(words)
        raw = ids.tobytes()
        return [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]

    def learn(self, plain: list[str], others: list[str]) -> dict[str, bytes]:
        """Keeps the ids of new words; those of LONGEST_WORD characters or more are returned instead."""
        long, found = {}, self.known
        for words, encode in ((plain, self.encode_plain), (others, self.encode)):
            short = [w for w in words if len(w) < LONGEST_WORD]
            for i in range(0, len(short), 5000):
                found.update(zip(short[i : i + 5000], encode(short[i : i + 5000]), strict=True))
            long.update((w, encode([w])[0]) for w in words if len(w) >= LONGEST_WORD)
        return long

    def words(self, texts: pa.Array) -> pa.ListArray:
        odd = pc.match_substring_regex(texts, ODD_BLANK)
        if not pc.any(odd).as_py():
            return pc.ascii_split_whitespace(texts)
        return pa.array([BLANK.split(t) if o else t.split() for t, o in zip(texts.to_pylist(), odd.to_pylist(), strict=True)], pa.list_(pa.string()))

    def texts(self, texts: list[str] | pa.Array) -> Iterator[bytes]:
        """A few texts at a time: all their words are held at once."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        column = texts if isinstance(texts, pa.Array) else pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())
        lists = self.words(pc.ascii_lower(column))  # A-Z only: the tokenizer folds case itself
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        if not len(words):
            yield from (b"" for _ in range(len(column)))
            return
        stems = pc.utf8_rtrim(words, TAIL)
        plain = pc.match_substring_regex(stems, PLAIN)
        stems = pc.if_else(plain, stems, words)  # other words stay whole
        heads, all_words, is_plain = (x.to_numpy(zero_copy_only=False) for x in (stems, words, plain))
        others = set(heads[~is_plain])
        heads = heads.tolist()
        ends = [w[len(h) :] for w, h in zip(all_words.tolist(), heads, strict=True)]
        others.update(ends)
        others.discard("")
        known = self.known
        long = self.learn([w for w in dict.fromkeys(heads) if w not in known and w not in others and w], [w for w in others if w not in known])
        known[""] = b""
        each = [(known[w] if w in known else long[w]) + known[e] if e else known[w] if w in known else long[w] for w, e in zip(heads, ends, strict=True)]
        yield from joined(each, coded.indices.to_numpy(), lists.offsets.to_numpy())


def joined(each: list[bytes], which: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
    """Rows of ids: each[which[k]] for the k from one offset to the next. Offsets may begin anywhere."""
    size = np.fromiter(map(len, each), np.int64, len(each)) // 4
    flat = np.frombuffer(b"".join(each), "<u4")
    begin = (np.cumsum(size) - size)[which]
    size = size[which]
    ends = np.concatenate(([0], np.cumsum(size)))
    ids = flat[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
    cuts = ends[offsets - offsets[0]].tolist()
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield ids[a:b].tobytes()


#: Kept by the worker process from task to task, by path.
_IDS: dict[str, Ids] = {}


def ids_by(path: str) -> Ids:
    if path not in _IDS:
        _IDS[path] = Ids(path)
    return _IDS[path]


def sound(column: pa.Array) -> pa.Array:
    """Texts without nulls, bytes that aren't UTF-8 replaced."""
    column = column.cast(pa.string()) if not pa.types.is_string(column.type) else column
    try:
        column.validate(full=True)
    except pa.ArrowInvalid:
        column = pa.array([(r or b"").decode("utf-8", "replace") for r in column.view(pa.binary()).to_pylist()], pa.string())
    return column.fill_null("")


def decompose(docs: DataFrame, path: str, most: int = MOST, end: int = END) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, ids (little-endian, 4 bytes each), and for numbering the
    task (part) and how many pieces of this length that task had made before (nth)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    tail = np.array([end], "<u4").tobytes()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        ids, part, made = ids_by(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            owner, cols, held = [], ([], [], [], [], [], []), 0
            for i, raw in enumerate(ids_of(ids, sound(b.column("text")))):
                raw += tail
                n = len(raw) // 4
                for start, length in pieces(n, most):
                    own = raw[4 * start : 4 * (start + length)]
                    for c, v in zip(cols, (start, length, zlib.crc32(own), n, own, made[length]), strict=True):
                        c.append(v)
                    made[length] += 1
                    owner.append(i)
                held += len(raw)
                if held > 16_000_000:
                    yield rows(b, owner, cols, part)
                    owner, cols, held = [], ([], [], [], [], [], []), 0
            yield rows(b, owner, cols, part)

    def ids_of(ids, column):
        sizes = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(column):
            limit = AT_ONCE + (int(sizes[at - 1]) if at else 0)
            stop = max(int(np.searchsorted(sizes, limit, "right")), at + 1)
            yield from ids.texts(column.slice(at, stop - at))
            at = stop

    def rows(b, owner, cols, part):
        start, length, crc, n, own, nth = cols
        numbers = (*(pa.array(c, pa.int64()) for c in (start, length, crc, n)), pa.array(own, pa.binary()), pa.array([part] * len(owner), pa.int32()), pa.array(nth, pa.int64()))
        return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(owner, pa.int64())), *numbers], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "part", "nth"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part int, nth long")


def number(parts: DataFrame) -> DataFrame:
    """Adds sequence_id, gapless over buckets of equal length, and offset 0. parts must be a written table: a task's counts then don't change.

    Prefix sums are over the tasks' totals only, first inside groups of GROUP tasks and then over the groups'.
    """
    totals = parts.groupBy("length", "part").agg(F.max("nth").alias("last")).withColumn("group", F.floor(F.col("part") / GROUP).cast("int"))
    of = Window.partitionBy("length", "group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    n = F.col("last") + 1
    inner = totals.select("length", "part", "group", F.coalesce(F.sum(n).over(of), F.lit(0)).alias("inside"))
    groups = totals.groupBy("length", "group").agg(F.sum(n).alias("n"))  # a row for GROUP tasks and each of 12 lengths
    every = Window.orderBy(F.desc("length"), "group").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "group", F.coalesce(F.sum("n").over(every), F.lit(0)).alias("before"))
    first = inner.join(groups, ["length", "group"]).select("length", "part", (F.col("before") + F.col("inside")).alias("first"))
    out = parts.join(first, ["length", "part"]).withColumn("sequence_id", F.col("first") + F.col("nth")).withColumn("offset", F.lit(0).cast("long"))
    return out.drop("part", "nth", "first")


def pack(docs: DataFrame, path: str, most: int = MOST, end: int = END) -> DataFrame:
    """All pieces with their ids and their sequences."""
    return number(cut(decompose(docs, path, most, end), "pieces"))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(docs: DataFrame, path: str) -> DataFrame:
    """All pieces, with a digest in place of their ids."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return number(cut(decompose(docs, path).drop("ids"), "pieces")).select(*columns, "sequence_id", "offset")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return packed(table(spark, sf_dir, "documents"), tokenizer_path())
