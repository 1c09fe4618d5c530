"""Relations between chunks and elements of one file: assignment, containment, parents, usage, grouping."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines of a bucket: range joins meet on (file, bucket), so a long file isn't one all-to-all group.
BUCKET = 256


def bucketed(rows: DataFrame, start: str, end: str, bucket: int = BUCKET) -> DataFrame:
    """Rows once for each bucket of lines that they touch."""
    return rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(start) / bucket).cast("int"), F.greatest(F.floor(F.col(end) / bucket), F.floor(F.col(start) / bucket)).cast("int"))))


def belongs(start: Column, end: Column, line: Column, last: Column) -> Column:
    """An element [line, last] belongs to a chunk [start, end): contained, containing, or overlapping it by over 30 % of its own length."""
    contained = (line >= start) & (last < end)
    containing = (line <= start) & (last >= end)
    touches = ((line >= start) & (line < end)) | ((last >= start) & (last < end))
    share = (F.least(last, end) - F.greatest(line, start)) / F.nullif(last - line, F.lit(0))
    return contained | containing | (touches & (last > line) & F.coalesce(share > 0.3, F.lit(False)))


def assigned(chunks: DataFrame, elements: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, chunk_id, element_id) for chunks (start_line, end_line) and elements (line, last)."""
    c = bucketed(chunks.select(by, "chunk_id", "start_line", "end_line"), "start_line", "end_line")
    e = bucketed(elements.select(by, "element_id", F.col("start_line").alias("line"), F.col("end_line").alias("last")), "line", "last")
    return c.join(e, [by, "bucket"]).where(belongs(F.col("start_line"), F.col("end_line"), F.col("line"), F.col("last"))).select(by, "chunk_id", "element_id").distinct()


def hierarchy(elements: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, outer, inner): the inner element's lines lie in the outer's and aren't the same lines."""
    o = bucketed(elements.select(by, F.col("element_id").alias("outer"), F.col("start_line").alias("a"), F.col("end_line").alias("b")), "a", "b")
    i = elements.select(by, F.col("element_id").alias("inner"), F.col("start_line").alias("c"), F.col("end_line").alias("d")).withColumn("bucket", F.floor(F.col("c") / BUCKET).cast("int"))
    inside = (F.col("c") >= F.col("a")) & (F.col("d") <= F.col("b")) & ~((F.col("a") == F.col("c")) & (F.col("b") == F.col("d")))
    return o.join(i, [by, "bucket"]).where(inside).select(by, "outer", "inner")


def parents(elements: DataFrame, by: str = "file_id") -> DataFrame:
    """Adds parent_id: the last element named like what stands before the name's last dot, in the same file."""
    named = elements.groupBy(by, F.col("name").alias("parent_name")).agg(F.max_by("element_id", "element_no").alias("parent_id"))
    wanted = F.when(F.contains("name", F.lit(".")), F.regexp_extract("name", r"^(.*)\.[^.]*$", 1))
    return elements.withColumn("parent_name", wanted).join(named, [by, "parent_name"], "left").drop("parent_name")


def used_names(body: Column, names: list[str]) -> Column:
    """The names that the text has as whole words, sorted and joined by a comma."""
    pattern = r"(?U)\b(" + "|".join(names) + r")\b"
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(body, F.lit(pattern), F.lit(1)))), ", ")


def type_counts(elements: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, element_type_counts): a map."""
    counts = elements.groupBy(by, "element_type").agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("element_type", "n")))).alias("element_type_counts"))


def grouped(elements: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, element_type, names in order of their names)."""
    return elements.groupBy(by, "element_type").agg(F.array_sort(F.collect_list("name")).alias("names"))


def paired_tags(tags: DataFrame, by: str = "file_id") -> DataFrame:
    """Opening and closing tags (by, pos, tag, is_close) paired per name: each close with the nearest open one before it at its depth."""
    w = Window.partitionBy(by, "tag").orderBy("pos")
    depth = F.sum(F.when(F.col("is_close"), -1).otherwise(1)).over(w)
    t = tags.withColumn("depth", depth + F.col("is_close").cast("int"))
    before = F.last(F.when(~F.col("is_close"), F.col("pos")), True).over(Window.partitionBy(by, "tag", "depth").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return t.withColumn("open_pos", before).where("is_close and depth > 0 and open_pos is not null").select(by, "tag", "open_pos", F.col("pos").alias("close_pos"))


def next_at_most(values: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """For each place, the next one whose value is at most the place's limit, or len(values). One pass with a stack, which limits must
    let: a place that waits longer must not have a higher limit than those that came after it and still wait."""
    out, waiting = np.full(len(values), len(values)), []
    for i, (v, limit) in enumerate(zip(values.tolist(), limits.tolist(), strict=True)):
        while waiting and v <= waiting[-1][0]:
            out[waiting.pop()[1]] = i
        waiting.append((limit, i))
    return out


def _by_file(rows: DataFrame, by: str, columns: list[str], found, schema: str) -> DataFrame:
    """found(columns of one file's rows in line order, as arrays) gives columns; files are dealt out by their key."""
    kind = rows.schema[by].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        out = found(*(pdf[c].to_numpy() for c in columns))
        return pd.DataFrame({by: [key[0]] * len(next(iter(out.values()))), **out})

    return rows.groupBy(by).applyInPandas(run, f"`{by}` {kind}, {schema}")


def indented_ends(lines: DataFrame, heads: DataFrame, by: str = "path") -> DataFrame:
    """heads (by, pos, indent) with end_pos: the line before the next one that isn't blank and isn't indented further, else the last."""
    blank = F.trim("line") == ""
    rows = lines.select(by, "pos", F.length(F.regexp_extract("line", r"^\s*", 0)).alias("own"), blank.alias("blank"))

    def found(pos, own, blank):
        solid = np.flatnonzero(~blank)
        own = own[solid].astype(np.int64)
        nxt = next_at_most(own, own)
        ends = np.append(pos[solid] - 1, pos[-1])[nxt]
        return {"pos": pos[solid], "end_pos": ends}

    ends = _by_file(rows, by, ["pos", "own", "blank"], found, "pos int, end_pos int")
    return heads.join(ends, [by, "pos"], "left")


def braced_ends(lines: DataFrame, by: str = "path") -> DataFrame:
    """Lines that open a bracket, with the line where the balance comes back: (by, pos, end_pos)."""
    net = F.length(F.translate("line", "}", "")) - F.length(F.translate("line", "{", ""))
    rows = lines.select(by, "pos", net.alias("net"))

    def found(pos, net):
        after = np.cumsum(net.astype(np.int64))
        # only lines that open more than they close wait; a line's limit is the balance before it, which grows among those that wait
        waiting, heads, ends = [], [], []
        for i, (n, depth) in enumerate(zip(net.tolist(), after.tolist(), strict=True)):
            while waiting and depth <= waiting[-1][0]:
                heads.append(pos[waiting.pop()[1]])
                ends.append(pos[i])
            if n > 0:
                waiting.append((depth - n, i))
        return {"pos": np.array(heads, np.int32), "end_pos": np.array(ends, np.int32)}

    return _by_file(rows, by, ["pos", "net"], found, "pos int, end_pos int")
