"""Sampled segmentation into the pieces of a SentencePiece model, and its lossless inverse.

The lattice of a text has a node for each byte and an edge for each piece that spells the bytes between two nodes; single-byte
pieces make every text spellable. A path's probability is proportional to the product of its pieces' weights to the
power THETA; a piece's weight falls with its rank in the model (Zipf's law), a byte's is fixed. Forward filtering sums the weights of all
paths to each node; backward sampling then draws a path from the end, exactly by its probability. The random numbers are a
hash of (seed, row key, place of the chunk, step), so a row's segmentation doesn't depend on partitions, batches or retries.

A text is cut into chunks wherever no piece of the model holds the two bytes on either side, so no edge is lost, and a chunk's
lattice, of whatever length, is sampled on its own. Filters are kept by chunk, so that a chunk that occurs often is filtered once a
worker. Weights are kept as mantissa and exponent, so that long chunks don't underflow. Defined results: null and empty texts have
no pieces and decode to the empty text; a null key counts as 0; repeated rows are segmented alike; very long texts are one row in and
out; the column names ids and n_bytes of the input aren't read, but the key must not be called so.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

THETA = 0.5
#: Weight of a byte piece before THETA.
BYTE_WEIGHT = 1e-9
#: Edges of the chunks whose filter a worker keeps, chunks sampled at once, and bytes filtered at once.
KNOWN_EDGES, AT_ONCE, FILTER_BYTES = 6_000_000, 200_000, 400_000
SEED = 1469598103934665603


class Model:
    """Pieces as bytes by id; their trie as one table of moves; and which bytes stand side by side in some piece."""

    def __init__(self, path: str, theta: float = THETA):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes: list[bytes] = []
        self.byte_weight = BYTE_WEIGHT**theta
        self.byte_id = np.zeros(256, np.int32)
        order = sorted((i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))), key=lambda i: (-sp.get_score(i), i))
        rank = {i: k for k, i in enumerate(order)}
        moves: list[dict[int, int]] = [{}, {}]  # state 0 is the end of all ways, state 1 the root
        ids, self.joins = {}, np.zeros((256, 256), bool)
        for i in range(sp.get_piece_size()):
            raw = b""
            if sp.is_byte(i):
                raw = bytes([int(sp.id_to_piece(i)[3:5], 16)])
                self.byte_id[raw[0]] = i
            elif i in rank:
                raw = sp.id_to_piece(i).replace("▁", " ").encode()
                at = 1
                for c in raw:
                    at = moves[at].setdefault(c, len(moves))
                    if at == len(moves):
                        moves.append({})
                ids[at] = i
                self.joins[np.frombuffer(raw[:-1], np.uint8), np.frombuffer(raw[1:], np.uint8)] = True
            self.bytes.append(raw)
        self.longest = max(map(len, self.bytes))
        self.letter = np.zeros(256, np.int64)  # only bytes that pieces hold have columns of their own
        used = sorted({c for m in moves for c in m})
        self.letter[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        self.moves = np.zeros(len(moves) * self.width, np.int32)
        for state, m in enumerate(moves):
            for c, to in m.items():
                self.moves[state * self.width + self.letter[c]] = to
        self.piece, self.weight = np.full(len(moves), -1, np.int32), np.zeros(len(moves))
        for state, i in ids.items():
            self.piece[state], self.weight[state] = i, (1.0 / (rank[i] + 10)) ** theta

    def cuts(self, raw: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Where chunks of the bytes begin: at `begins`, and wherever no piece holds both the byte before and the one after."""
        apart = np.ones(len(raw), bool)
        apart[1:] = ~self.joins[raw[:-1], raw[1:]]
        apart[begins] = True
        return np.flatnonzero(apart)

    def chunks(self, raw: bytes) -> list[bytes]:
        at = [*self.cuts(np.frombuffer(raw, np.uint8), np.empty(0, np.int64)).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(at, at[1:], strict=False)]

    def filtered(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the nodes after each byte of the chunks, in a row: where its edges begin (one more entry closes the last), and for each
        edge, longest first, the cumulated share of the node's weight, the bytes it spells and its piece."""
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        raw = np.frombuffer(b"".join(chunks), np.uint8)
        first = np.cumsum(sizes) - sizes
        left = np.repeat(first + sizes, sizes) - np.arange(len(raw))  # bytes to the chunk's end
        letter = self.letter[raw]
        ends, spans, pieces, weights = [np.arange(len(raw))], [1], [self.byte_id[raw]], [self.byte_weight]
        live, state = np.arange(len(raw)), np.ones(len(raw), np.int64)
        for k in range(self.longest):
            state = self.moves[state * self.width + letter[live + k]]
            hit = np.flatnonzero(self.piece[state] >= 0)
            if len(hit):
                ends.append(live[hit] + k)
                spans.append(k + 1)
                pieces.append(self.piece[state[hit]])
                weights.append(self.weight[state[hit]])
            on = np.flatnonzero((state > 0) & (left[live] > k + 1))
            live, state = live[on], state[on].astype(np.int64)
            if not len(live):
                break
        count = np.bincount(np.concatenate(ends), minlength=len(raw))
        begin = np.concatenate(([0], np.cumsum(count)))
        span, piece, weight = np.empty(begin[-1], np.int32), np.empty(begin[-1], np.int32), np.empty(begin[-1])
        free = begin[:-1].copy()
        for e, n, i, w in zip(reversed(ends), reversed(spans), reversed(pieces), reversed(weights), strict=True):
            at = free[e]
            span[at], piece[at], weight[at] = n, i, w
            free[e] += 1
        # a node's weight is mantissa * 2**exponent, relative to that of its chunk's begin; all chunks go on together
        by_size = np.argsort(-sizes, kind="stable")
        first, alive = first[by_size], len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max())), "right")
        mantissa, exponent = np.ones(len(raw)), np.zeros(len(raw), np.int64)
        for j, n in enumerate(alive.tolist()):
            node = first[:n] + j
            many = count[node]
            here = np.cumsum(many) - many
            edges = np.repeat(begin[node] - here, many) + np.arange(int(many.sum()))
            value = weight[edges]
            if j:
                back = np.repeat(node, many) - span[edges]
                inner = span[edges] <= j  # else it comes from the chunk's begin
                base = np.repeat(exponent[node - 1], many)
                value = np.ldexp(np.where(inner, mantissa[back], 1.0) * value, (np.where(inner, exponent[back], 0) - base).astype(np.int32))
            total = np.add.reduceat(value, here)
            mantissa[node], more = np.frexp(total)
            exponent[node] = more + (exponent[node - 1] if j else 0)
            weight[edges] = value / np.repeat(total, many)
        share = weight.cumsum()
        share -= np.repeat(np.append(0.0, share)[begin[:-1]], count)
        share[begin[1:] - 1] = 2.0  # whatever rounding leaves, the last edge takes
        return begin, share.astype(np.float32), span, piece

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def uniform(seed: int, key: np.ndarray, place: np.ndarray, step: int) -> np.ndarray:
    """In [0, 1), from a hash of all four."""
    u = np.uint64
    x = key.astype(np.uint64) * u(0x9E3779B97F4A7C15) + place.astype(np.uint64) * u(0xC2B2AE3D27D4EB4F) + u((step * 0x165667B19E3779F9 + seed * 0xD6E8FEB86659FD93) & (2**64 - 1))
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> u(shift))) * u(mult)
    return ((x ^ (x >> u(31))) >> u(11)).astype(np.float64) / float(1 << 53)


class Sampler:
    """The filters of the chunks met, one row an edge, kept until there are too many."""

    def __init__(self, model: Model, seed: int):
        self.model, self.seed = model, seed
        self.clear()

    def clear(self):
        self.place: dict[bytes, int] = {}
        self.last = np.zeros(0, np.int64)  # of each chunk, its last node
        self.size = np.zeros(0, np.int64)
        self.begin, self.share, self.span, self.piece = np.zeros(1, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def learn(self, chunks: list[bytes]) -> None:
        new, at, held = [], 0, 0
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        for i, n in enumerate(sizes.tolist()):
            held += n
            if held >= FILTER_BYTES or i + 1 == len(chunks):
                new.append(self.model.filtered(chunks[at : i + 1]))
                at, held = i + 1, 0
        offset = self.begin[-1] + np.cumsum([0, *(len(x[1]) for x in new)])
        nodes = len(self.begin) - 1
        self.begin = np.concatenate([self.begin, *(x[0][1:] + o for x, o in zip(new, offset, strict=False))])
        self.share, self.span, self.piece = (np.concatenate([old, *(x[k] for x in new)]) for k, old in ((1, self.share), (2, self.span), (3, self.piece)))
        self.last = np.concatenate([self.last, nodes + np.cumsum(sizes) - 1])
        self.size = np.concatenate([self.size, sizes])
        self.place.update(zip(chunks, range(len(self.place), len(self.place) + len(chunks)), strict=True))

    def __call__(self, chunks: list[bytes] | pa.Array, key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in a row, how many for each chunk)."""
        coded = (chunks if isinstance(chunks, pa.Array) else pa.array(chunks, pa.binary())).dictionary_encode()
        kinds = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.share) > KNOWN_EDGES:
            self.clear()
        missing = [c for c in kinds if c not in self.place]
        if missing:
            self.learn(missing)
        which = np.fromiter(map(self.place.__getitem__, kinds), np.int64, len(kinds))[coded.indices.to_numpy()]
        node, left = self.last[which], self.size[which]
        live, made, number, step = np.arange(len(which)), [], np.zeros(len(which), np.int64), 0
        while len(live):
            u = uniform(self.seed, key[live], place[live], step).astype(np.float32)
            edge = self.begin[node]
            on = np.flatnonzero(self.share[edge] <= u)
            while len(on):
                edge[on] += 1
                on = on[self.share[edge[on]] <= u[on]]
            made.append((live, self.piece[edge]))
            number[live] += 1
            span = self.span[edge]
            left = left - span
            on = np.flatnonzero(left > 0)
            live, node, left = live[on], node[on] - span[on], left[on]
            step += 1
        begin = np.cumsum(number) - number
        out = np.empty(int(number.sum()), np.int32)
        for s, (at, got) in enumerate(made):
            out[begin[at] + number[at] - 1 - s] = got
        return out, number


#: Kept by the worker process from task to task, by path, theta and seed.
_SAMPLERS: dict[tuple, Sampler] = {}


def sampler_by(path: str, theta: float = THETA, seed: int = 0) -> Sampler:
    if (path, theta, seed) not in _SAMPLERS:
        _SAMPLERS[path, theta, seed] = Sampler(Model(path, theta), seed)
    return _SAMPLERS[path, theta, seed]


def encoder(path: str, key: str, seed: int, theta: float):
    """Batches (key, raw, _k) to batches (key, ids, n_bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = sampler_by(path, theta, seed)
        for b in batches:
            raws = b.column("raw").fill_null(b"")
            sizes = np.fromiter((len(r) for r in raws.to_pylist()), np.int64, len(raws))
            ends = np.cumsum(sizes)
            data = np.frombuffer(b"".join(raws.to_pylist()), np.uint8)
            cuts = sampler.model.cuts(data, (ends - sizes)[sizes > 0])
            owner = np.searchsorted(ends, cuts, "right")
            begins = np.searchsorted(cuts, ends - sizes)
            place = np.arange(len(cuts)) - begins[owner]
            keys = b.column("_k").fill_null(0).to_numpy(zero_copy_only=False)
            cuts = np.append(cuts, len(data))
            buffer, made, numbers = pa.py_buffer(data), [], []
            for at in range(0, len(cuts) - 1, AT_ONCE):
                part = cuts[at : min(at + AT_ONCE, len(cuts) - 1) + 1]
                some = pa.Array.from_buffers(pa.large_binary(), len(part) - 1, [None, pa.py_buffer(part.astype(np.int64)), buffer])
                ids, number = sampler(some, keys[owner[at : at + AT_ONCE]], place[at : at + AT_ONCE])
                made.append(ids)
                numbers.append(number)
            per = np.bincount(owner, np.concatenate(numbers) if numbers else None, len(raws)).astype(np.int64)
            offsets = np.concatenate(([0], np.cumsum(per))).astype(np.int32)
            ids = np.concatenate(made) if made else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays([b.column(key), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)), pa.array(sizes)], names=[key, "ids", "n_bytes"])

    return run


def _source(docs: DataFrame, key: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(text).cast("binary").alias("raw"), (F.col(key) if kind in ("bigint", "int", "smallint") else F.xxhash64(key)).cast("long").alias("_k"))


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", seed: int = 0, theta: float = THETA) -> DataFrame:
    """(key, ids, n_bytes): ids is an array of piece ids."""
    kind = docs.schema[key].dataType.simpleString()
    return _source(docs, key, text).mapInArrow(encoder(path, key, seed, theta), f"`{key}` {kind}, ids array<int>, n_bytes long")


def decode(encoded: DataFrame, path: str, key: str = "doc_id") -> DataFrame:
    """(key, text) from (key, ids)."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sampler_by(path).model
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([model.decode(ids or []).decode("utf-8", "replace") for ids in b.column("ids").to_pylist()], pa.string())], names=[key, "text"])

    return encoded.select(key, "ids").mapInArrow(run, f"`{key}` {kind}, text string")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_pieces(spark, sf_dir: str) -> DataFrame:
    """Per document: pieces, a digest of their ids, and the crc32 of what they decode to."""
    from .common import table

    path = model_path()
    docs = table(spark, sf_dir, "documents")
    encoded = encoder(path, "doc_id", 0, THETA)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sampler_by(path).model
        for b in encoded(batches):
            lists = b.column("ids")
            values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            spans = [values[a:e] for a, e in zip(ends[:-1], ends[1:], strict=True)]
            cols = [[len(s) for s in spans], [zlib.crc32(s.astype("<u4").tobytes()) for s in spans], [zlib.crc32(model.decode(s.tolist())) for s in spans]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "n_bytes", "n_pieces", "ids_crc32", "decoded_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _source(docs, "doc_id", "text").mapInArrow(digest, f"doc_id {kind}, n_bytes long, n_pieces long, ids_crc32 long, decoded_crc32 long")
