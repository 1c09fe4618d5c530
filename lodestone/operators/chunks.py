"""Chunkers: blocks by blank lines and indentation packed to size, Markdown by headings and fences, and each chunk's metadata.

Chunks are line ranges, 0-based, with exclusive end. Packing depends on what was packed before, so it is a fold over one file's array of
segments; the fold runs in the JVM where it is plain, and Arrow batches of whole files go to Python where a segment must be cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config
from ..functions import text as X

CHUNK_FIELDS = "start_line int, end_line int"
#: Tokens in a Markdown chunk at most, and below which chunks are joined.
MARKDOWN_TOKENS, MARKDOWN_COALESCE = 1024, 341


def coalesced(sizes: Column, most: int) -> Column:
    """Greedy groups of an ordered array of sizes: a group takes the next size while the sum stays within `most`. Array of sums."""
    def step(acc: Column, v: Column) -> Column:
        joined = acc["open"].isNotNull() & (acc["open"] + v <= most)
        return F.struct(
            F.when(joined, acc["done"]).otherwise(F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))).alias("done"),
            F.when(joined, acc["open"] + v).otherwise(v).alias("open"),
        )

    zero = F.struct(F.array().cast("array<int>").alias("done"), F.lit(None).cast("int").alias("open"))
    return F.aggregate(sizes, zero, step, lambda acc: F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"]))))


def gap_filled(spans: DataFrame, by: str, start: str = "start_line", end: str = "end_line", last: str | None = None) -> DataFrame:
    """Each span ends where the next begins; the last one keeps its end or takes the column `last`."""
    follow = F.lead(start).over(Window.partitionBy(by).orderBy(start))
    return spans.withColumn(end, F.coalesce(follow, F.col(last or end)))


def segments(lines: DataFrame, is_boundary: Column, by: str = "path", pos: str = "pos") -> DataFrame:
    """Adds segment, which grows by one at each boundary line."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("segment", F.sum(is_boundary.cast("int")).over(w))


def line_offsets(lines: DataFrame, by: str = "path", pos: str = "pos", line: str = "line") -> DataFrame:
    """Adds offset, the bytes before each line with one for each line end: offset to line by comparison."""
    w = Window.partitionBy(by).orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("offset", F.coalesce(F.sum(F.octet_length(line) + 1).over(w), F.lit(0)))


def is_markdown_boundary(line: Column | str) -> Column:
    s = X.col(line)
    return s.rlike(r"^#{1,6}\s+.+$") | s.rlike(r"^\s*[-*_]{3,}\s*$") | s.rlike(r"^\s*```")


# --- one file at a time, in Python ---------------------------------------------------------------------------------------------


def top_level_blocks(lines: list[str]) -> list[tuple[int, int]]:
    """Runs that begin at an unindented line after a blank one or where a block has closed; they cover the file."""
    starts, depth, fresh = [0], 0, True
    for i, s in enumerate(lines):
        bare = s.strip()
        if i and fresh and bare and not s[:1].isspace() and depth <= 0 and not bare.startswith(("}", ")", "]", "else", "elif", "except", "finally")):
            starts.append(i)
        depth += sum(s.count(c) for c in "{([") - sum(s.count(c) for c in "})]")
        fresh = not bare or depth <= 0
    return [(a, b) for a, b in zip(starts, [*starts[1:], len(lines)], strict=True) if a < b]


def runs(sizes: list[int], most: int) -> list[int]:
    """Where greedy runs begin: a run takes the next size while its sum stays within most."""
    starts, held = [], 0
    for i, n in enumerate(sizes):
        if not starts or held + n > most:
            starts.append(i)
            held = 0
        held += n
    return starts


def packed(lines: list[str], max_chars: int, coalesce_chars: int) -> list[tuple[int, int]]:
    """Stretches of blocks, and apart from them the lines of each block that is larger than max_chars bytes, are dealt into runs within it.
    Neighbouring runs are then joined until they hold more than coalesce_chars non-blank characters and more than one line."""
    octets = list(accumulate((len(s.encode()) + 1 for s in lines), initial=0))
    solid = list(accumulate((len("".join(s.split())) for s in lines), initial=0))
    units, stretch = [], 0  # (first line, stretch): only units of one stretch may share a run
    for a, b in top_level_blocks(lines):
        large = octets[b] - octets[a] > max_chars
        stretch += large
        units += [(i, stretch) for i in range(a, b)] if large else [(a, stretch)]
        stretch += large
    edges = [*(u for u, _ in units), len(lines)]
    sizes, begins = [octets[y] - octets[x] for x, y in pairwise(edges)], []
    for _, group in groupby(range(len(units)), key=lambda k: units[k][1]):
        own = list(group)
        begins += [edges[own[i]] for i in runs([sizes[k] for k in own], max_chars)]
    out, at = [], 0
    for end in [*begins[1:], len(lines)] if begins else []:
        if (solid[end] - solid[at] > coalesce_chars and end - at > 1) or end == len(lines):
            out.append((at, end))
            at = end
    return out


def tokens(text: str) -> int:
    return len(text) // 4


def _heading(s: str) -> bool:
    return bool(re.match(r"#{1,6}\s+\S", s))


def _rule(s: str) -> bool:
    return bool(re.fullmatch(r"[-*_]{3,}", s.strip()))


class Measure:
    """Tokens of line ranges, from sums of the lines' lengths."""

    def __init__(self, lines: list[str]):
        self.ends = list(accumulate((len(s) + 1 for s in lines), initial=0))

    def __call__(self, a: int, b: int) -> int:
        return max(self.ends[b] - self.ends[a] - 1, 0) // 4

    def reach(self, a: int, b: int, most: int) -> int:
        """The largest end up to b with which a range from a on has `most` tokens at most."""
        return bisect_right(self.ends, self.ends[a] + 4 * most + 4, a, b + 1) - 1


def split_point(lines: list[str], start: int, end: int, most: int) -> int:
    """Before the first heading, or after the first blank line, if what stands before fits; else after as many lines as fit, one at least."""
    reach = Measure(lines).reach(start, end, most)
    natural = next((i if _heading(lines[i]) else i + 1 for i in range(start + 1, end) if _heading(lines[i]) or not lines[i].strip()), end)
    return natural if natural <= reach else max(reach, start + 1)


def markdown_spans(lines: list[str], most: int = MARKDOWN_TOKENS, coalesce: int = MARKDOWN_COALESCE) -> list[tuple[int, int]]:
    """Sections between headings, rules and fences. A section above `most` is cut in two once, its first part standing alone. A chunk
    takes the next section if either is below `coalesce` and both fit, and ends when that brings it to `coalesce`."""
    size = Measure(lines)
    bounds = [0, *(i for i, s in enumerate(lines) if i and (_heading(s) or _rule(s) or s.strip().startswith("```"))), len(lines)]
    out: list[tuple[int, int]] = []
    held = None  # tokens of the last chunk, summed by section, while it may take another
    for a, b in pairwise(bounds if lines else []):
        if b - a > 1 and size(a, b) > most:
            a, first = split_point(lines, a, b, most), a
            out.append((first, a))
            held = None
        n = size(a, b)
        if held is not None and min(held, n) < coalesce and held + n <= most:
            out[-1] = (out[-1][0], b)
            held = held + n if held + n < coalesce else None
        else:
            out.append((a, b))
            held = n
    return out


#: Chunkers by name, and the extensions that each takes; others go to `code`, and to `markdown` when that finds nothing.
CODE_EXTENSIONS = (".py", ".java", ".js", ".jsx", ".ts", ".tsx", ".go", ".cpp", ".c", ".h", ".hpp", ".cs", ".rb", ".php", ".swift", ".kt", ".rs", ".scala", ".html", ".css")
MARKDOWN_EXTENSIONS = (".md", ".markdown", ".txt", ".rst", ".pdf", ".docx", ".pptx", ".xlsx", ".xls", ".msg", ".eml")


def chunker_name(path: Column | str) -> Column:
    return F.when(F.lower(X.extension(path)).isin(list(MARKDOWN_EXTENSIONS)), "markdown").otherwise("code")


def chunk_spans(text: str, chunker: str, max_chars: int, coalesce_chars: int) -> list[tuple[int, int]]:
    lines = text.splitlines()
    if chunker == "markdown":
        return markdown_spans(lines)
    return packed(lines, max_chars, coalesce_chars) or markdown_spans(lines)


def limits(language: Column) -> tuple[Column, Column]:
    """(max_chars, coalesce_chars) of a language."""
    sizes = {k: v for k, v in config.LANGUAGES.items()}
    most, least = F.lit(sizes["default"].max_chars), F.lit(sizes["default"].coalesce_chars)
    for k, v in sizes.items():
        if k != "default":
            most, least = F.when(language == k, v.max_chars).otherwise(most), F.when(language == k, v.coalesce_chars).otherwise(least)
    return most, least


def chunked(files: DataFrame, max_chars: int | None = None, coalesce_chars: int | None = None) -> DataFrame:
    """(file_id, path, language, chunk_id, start_line, end_line, content) of files (file_id, path, text); whole files stream in Arrow batches."""
    language = X.language_of("path")
    most, least = limits(language)
    source = files.select(
        "file_id", "path", language.alias("language"), chunker_name("path").alias("chunker"), (F.lit(max_chars) if max_chars else most).alias("most"), (F.lit(coalesce_chars) if coalesce_chars else least).alias("least"), "text"
    )
    kind = files.schema["file_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n, starts, ends, texts = [], [], [], [], []
            for i, (text, chunker, most, least) in enumerate(zip(*(b.column(c).to_pylist() for c in ("text", "chunker", "most", "least")), strict=True)):
                lines = (text or "").splitlines()
                for k, (a, e) in enumerate(chunk_spans(text or "", chunker, most, least)):
                    at.append(i)
                    n.append(k)
                    starts.append(a)
                    ends.append(e)
                    texts.append("\n".join(lines[a:e]))
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c).take(take) for c in ("file_id", "path", "language")), *(pa.array(x, pa.int32()) for x in (n, starts, ends)), pa.array(texts, pa.string())],
                names=["file_id", "path", "language", "chunk_id", "start_line", "end_line", "content"],
            )

    return source.mapInArrow(run, f"file_id {kind}, path string, language string, chunk_id int, {CHUNK_FIELDS}, content string")


def described(chunks: DataFrame) -> DataFrame:
    """Adds chunk_type, non_whitespace_len, tokens, quality_score, framework, special_patterns and title. Markdown has its own types and no quality."""
    markdown = chunker_name("path") == "markdown"
    ignored, structure = X.ratios("content", F.col("language"))
    out = chunks.withColumns({"_i": ignored, "_s": structure})
    return out.select(
        *chunks.columns,
        F.when(markdown, X.markdown_type("content")).otherwise(X.chunk_type(F.col("_i"), F.col("_s"))).alias("chunk_type"),
        X.non_blank_length("content").alias("non_whitespace_len"), X.token_count("content").alias("tokens"),
        F.when(markdown, 0.0).otherwise(X.quality(F.col("_i"), F.col("_s"))).alias("quality_score"),
        X.framework_of_chunk("content").alias("framework"), X.special_flags("content", F.col("language")).alias("special_patterns"),
        X.title("content", F.col("start_line"), F.col("end_line")).alias("title"),
    )
