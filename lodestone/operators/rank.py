"""Ranking beyond single hits: file quality, low-value files, and a map of the corpus by graph rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

#: FIXED VALUES: suffixes of files that search gains little from.
LOW_VALUE = (".min.js", ".min.css", ".lock", ".map", ".svg", ".snap", ".pb.go", "_pb2.py", ".generated.ts", "package-lock.json", "yarn.lock")


def quality_bonus(lines: Column, commits: Column, hours: Column) -> Column:
    """min(lines / 20, 10) * (commits + 1) / (hours since the last change + 1)."""
    return F.least(lines / 20, F.lit(10.0)) * (commits + 1) / (hours + 1)


def with_percentile(rows: DataFrame, score: str, by: str | None = None, cells: int = 4096) -> DataFrame:
    """Adds percentile, the share of rows with a lower score, as percent_rank() has it. Ranks come from totals of range partitions, so
    that no task holds all rows; `by` restarts the ranks."""
    if by is not None:
        return rows.withColumn("percentile", F.percent_rank().over(Window.partitionBy(by).orderBy(score)))
    counts = rows.groupBy(score).agg(F.count("*").alias("_n"))
    edges = [r[0] for r in counts.sample(False, min(1.0, cells * 4 / max(counts.count(), 1)), seed=1).select(score).where(f"`{score}` is not null").orderBy(score).limit(cells * 8).collect()]
    step = max(1, len(edges) // 64)
    marks = edges[::step]
    cell = F.lit(0)
    for m in marks:
        cell = cell + (F.col(score) >= F.lit(m)).cast("int")
    counts = counts.withColumn("_cell", F.coalesce(cell, F.lit(-1)))
    inside = Window.partitionBy("_cell").orderBy(F.col(score).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    totals = counts.groupBy("_cell").agg(F.sum("_n").alias("_t"))
    above = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # one row a cell
    totals = totals.select("_cell", F.coalesce(F.sum("_t").over(above), F.lit(0)).alias("_before"), F.sum("_t").over(Window.partitionBy(F.lit(1))).alias("_all"))
    ranked = counts.join(F.broadcast(totals), "_cell").withColumn("_below", F.col("_before") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    ranked = ranked.select(F.col(score).alias("_s"), F.coalesce(F.try_divide(F.col("_below").cast("double"), F.col("_all") - 1), F.lit(0.0)).alias("percentile"))
    return rows.join(ranked, F.col(score).eqNullSafe(F.col("_s"))).drop("_s")


def is_low_value(path: Column | str) -> Column:
    p, out = F.lower(X.col(path)), F.lit(False)
    for s in LOW_VALUE:
        out = out | p.endswith(s)
    return out


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85, every: int = 4) -> DataFrame:
    """(node, rank) of edges (src, dst, weight); rank that ends in nodes without outgoing edges is spread over all nodes. Lineage is cut every few rounds
    by checkpoint(), where a checkpoint folder is set."""
    edges = edges.persist()
    out = edges.groupBy("src").agg(F.sum("weight").alias("total"))
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    nodes = nodes.join(out.select(F.col("src").alias("node"), F.lit(True).alias("sends")), "node", "left").persist()
    n = max(nodes.count(), 1)
    shares = edges.groupBy("src", "dst").agg(F.sum("weight").alias("weight")).join(out, "src").select("src", "dst", (F.col("weight") / F.col("total")).alias("share")).persist()
    ranks = nodes.withColumn("rank", F.lit(1.0 / n)).persist()
    can_cut = edges.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    for i in range(rounds):
        lost = ranks.where("sends is null").agg(F.sum("rank")).first()[0] or 0.0  # one number, and the round before is then cached
        got = ranks.join(shares, ranks.node == shares.src).groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = nodes.join(got, "node", "left").select("node", "sends", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        ranks = new.checkpoint() if can_cut and (i + 1) % every == 0 else new.persist()
    return ranks.select("node", "rank")


def reference_edges(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """(src, dst, weight): files that refer to a name, to the files that define it; both (path, name). A name defined in d files shares its weight."""
    d = definitions.select("name", F.col("path").alias("dst")).distinct()
    shared = d.groupBy("name").agg(F.count("*").alias("d"))
    r = references.groupBy("name", F.col("path").alias("src")).agg(F.count("*").alias("times"))
    return r.join(d, "name").join(shared, "name").where("src <> dst").groupBy("src", "dst").agg(F.sum(F.sqrt("times") / F.col("d")).alias("weight"))


def reference_rank(definitions: DataFrame, references: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """page_rank(reference_edges(definitions, references)) without the pairs of paths: rank goes from path to name to path, so rows
    grow with definitions and references only, however many paths define a name. Each round reads the ranks twice, so lineage is cut every round."""
    can_cut = definitions.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined()
    settled = lambda df: df.checkpoint() if can_cut else df.localCheckpoint()
    d = definitions.select("name", F.col("path").alias("dst")).distinct()
    r = references.groupBy("name", F.col("path").alias("src")).agg(F.sqrt(F.count("*")).alias("w"))
    shared = d.groupBy("name").agg(F.count("*").alias("d"))
    own = d.select("name", F.col("dst").alias("src"), F.lit(1).alias("own"))
    r = r.join(shared, "name").join(own, ["name", "src"], "left").select("name", "src", "w", "d", F.coalesce("own", F.lit(0)).alias("own"))
    total = r.groupBy("src").agg(F.sum(F.col("w") * (F.col("d") - F.col("own")) / F.col("d")).alias("total")).where("total > 0")
    total = settled(total)
    r = settled(r.join(total, "src").select("name", "src", "own", (F.col("w") / F.col("total")).alias("share")))
    # a path gets rank through a name that it defines and another path refers to
    users = r.groupBy("name").agg(F.count("*").alias("users"))
    mine = r.where("own = 1").select("name", F.col("src").alias("dst"), F.col("share").alias("mine"))
    d = d.join(shared, "name").join(users, "name").join(mine, ["name", "dst"], "left").where(F.col("users") > F.col("mine").isNotNull().cast("int"))
    d = settled(d.select("name", "dst", "d", F.coalesce("mine", F.lit(0.0)).alias("mine")))
    nodes = total.select(F.col("src").alias("node")).union(d.select("dst")).distinct()
    nodes = settled(nodes.join(total.select(F.col("src").alias("node"), F.lit(True).alias("sends")), "node", "left"))
    n = max(nodes.count(), 1)
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for _ in range(rounds):
        lost = ranks.where("sends is null").agg(F.sum("rank")).first()[0] or 0.0
        names = r.join(ranks, r.src == ranks.node).groupBy("name").agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        back = ranks.select(F.col("node").alias("dst"), F.col("rank").alias("old"))
        got = d.join(names, "name").join(back, "dst").groupBy(F.col("dst").alias("node")).agg(F.sum((F.col("flow") - F.col("old") * F.col("mine")) / F.col("d")).alias("got"))
        new = nodes.join(got, "node", "left").select("node", "sends", (F.lit((1 - damping) / n + damping * lost / n) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        ranks = settled(new)
    return ranks.select("node", "rank")


def corpus_map(definitions: DataFrame, ranks: DataFrame, tokens: int = 1024, most: int = 10_000) -> DataFrame:
    """The definitions of the best files, in rank order, while their names fit the budget; the `most` best rows at most can fit any budget asked for."""
    best = definitions.join(ranks.withColumnRenamed("node", "path"), "path").withColumn("cost", X.token_count("name") + 1).orderBy(F.desc("rank"), "path", "name").limit(most)
    w = Window.orderBy(F.desc("rank"), "path", "name").rowsBetween(Window.unboundedPreceding, 0)
    return best.withColumn("spent", F.sum("cost").over(w)).where(F.col("spent") <= tokens).drop("cost")
