"""Text renderings of structures. Per-file ones are expressions or Arrow batches over grouped rows; trees of one listing are made on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import config


def category_rank(kind: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in zip(config.CATEGORY_ORDER, range(len(config.CATEGORY_ORDER)), strict=True) for x in kv)), kind), F.lit(len(config.CATEGORY_ORDER)))


def structure_tree(elements: DataFrame, by: str = "path") -> DataFrame:
    """(by, tree): categories in their order, names sorted within, as lines with branches."""
    rank = category_rank(F.col("element_type"))
    types = elements.groupBy(by, rank.alias("rank"), "element_type").agg(F.array_sort(F.collect_list(F.struct("name", "start_line", "end_line"))).alias("own"))

    def branch(x: Column, i: Column) -> Column:
        return F.concat(F.when(i == F.size("own") - 1, "│   └── ").otherwise("│   ├── "), x["name"], F.lit(" ("), (x["start_line"] + 1).cast("string"), F.lit("-"), (x["end_line"] + 1).cast("string"), F.lit(")"))

    block = F.concat(F.lit("├── "), F.col("element_type"), F.lit("\n"), F.array_join(F.transform("own", branch), "\n"))
    rows = types.select(by, F.struct("rank", "element_type", block.alias("block")).alias("b"))
    lists = rows.groupBy(by).agg(F.array_sort(F.collect_list("b")).alias("bs"))
    return lists.select(by, F.concat(F.col(by).cast("string"), F.lit("\n"), F.array_join(F.transform("bs", lambda b: b["block"]), "\n")).alias("tree"))


def fragments(assigned: DataFrame, elements: DataFrame, by: str = "file_id") -> DataFrame:
    """(by, chunk_id, fragments): `type name (a-b)` of a chunk's elements in line order, joined by a semicolon."""
    e = elements.select(by, "element_id", F.struct("start_line", "element_type", "name", "end_line").alias("e"))
    text = lambda x: F.concat_ws(" ", x["element_type"], x["name"], F.concat(F.lit("("), (x["start_line"] + 1).cast("string"), F.lit("-"), (x["end_line"] + 1).cast("string"), F.lit(")")))
    return assigned.join(e, [by, "element_id"]).groupBy(by, "chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), text), "; ").alias("fragments"))


def chunk_line(start: Column, end: Column, kind: Column, framework: Column, title: Column) -> Column:
    """`Chunk a-b TYPE [framework] title` with lines as shown to people."""
    return F.concat(
        F.lit("Chunk "), (start + 1).cast("string"), F.lit("-"), end.cast("string"), F.lit(" "), F.upper(kind), F.when(framework.isNotNull(), F.concat(F.lit(" ["), framework, F.lit("]"))).otherwise(""), F.lit(" "), title
    )


def directory_tree(entries: list[dict]) -> str:
    """entries: path, is_directory, in order, parents first."""
    children: dict[str, list[dict]] = {}
    for e in entries:
        children.setdefault(e["path"].rpartition("/")[0], []).append(e)
    out: list[str] = []

    def show(parent: str, lead: str) -> None:
        own = children.get(parent, [])
        for i, e in enumerate(own):
            last = i == len(own) - 1
            name = e["path"].rpartition("/")[2]
            out.append(f"{lead}{'└── ' if last else '├── '}{name}{'/' if e['is_directory'] else ''}")
            if e["is_directory"]:
                show(e["path"], lead + ("    " if last else "│   "))

    show("", "")
    return "\n".join(out)
