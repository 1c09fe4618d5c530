"""Nearest neighbours by largest inner product, by collision-counting hashing.

Vectors are scaled by the largest norm and get one more component that brings them to the unit sphere, where the order by inner
product with a query is that by distance. Each block of vectors has M hash functions: one random projection each, kept as a
sorted array. A query opens a window around its own projection in every array and widens it from radius to radius (virtual
rehashing: nothing is rebuilt); a vector counts one collision for each array whose window holds it. Vectors with as many
collisions as those within the radius show with near certainty are verified by their exact inner product. A query stops
once its k best verified ones lie within the radius, or when its windows hold whole blocks, where every vector is verified; there's
no cap on candidates.

Blocks of vectors meet blocks of queries; a block's index is built once for all queries that stream past it. Both have at most BLOCK
rows, so memory doesn't grow with the table and either side is copied as seldom as the other. A bounded sample of vectors first gives each
query a score that its k-th neighbour surely reaches, so that it leaves blocks early which hold nothing better; results come from the
blocks alone. Each meeting gives at most k rows a query, and a window function keeps the k best. The chance that a true neighbour is
missed is set by Z; recall is measured against brute force in the tests.

Defined results: vectors that are null, empty, all zero or with null or non-finite components take no part; vectors meet only
those of their own dimension; equal scores go by smaller id; a query is never its own neighbour (rows that repeat its id aren't
either); with fewer than k candidates all are returned; columns other than the id and the vector aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Projections, width of a window in radii, deviations of slack in the collision threshold, growth of the radius.
M, WIDTH, Z, GROWTH = 48, 1.0, 1.8, 1.3
#: Rows of a block, the fewest that are worth one, and vectors of the sample that bounds the scores.
BLOCK, LEAST_BLOCK, SAMPLE = 16_384, 8_192, 4_096


def chance(width: float) -> float:
    """Of a collision, at a distance of one radius."""
    return math.erf(width / math.sqrt(2))


class Block:
    """Sorted projections of unit vectors x, and the place of each vector in each; own holds what scores are computed from."""

    def __init__(self, x: np.ndarray, own: np.ndarray, ids: np.ndarray, seed: int = 20_240_229):
        rng = np.random.default_rng(seed)
        self.a = rng.standard_normal((x.shape[1], M))
        p = (x @ self.a).T
        self.order = np.argsort(p, axis=1)
        self.sorted = np.take_along_axis(p, self.order, 1)
        # all arrays in one, each moved beyond the one before; needles are kept within reach of their own
        self.reach = float(np.abs(p).max()) + 1.0
        self.rows = np.tile(np.arange(M) * 4 * self.reach, 2)
        self.begins = np.arange(M) * len(ids)
        self.flat = (self.sorted + self.rows[:M, None]).ravel()
        self.place = np.empty(p.shape, np.uint16 if len(ids) < 1 << 15 else np.uint32)
        np.put_along_axis(self.place, self.order, np.arange(len(ids), dtype=self.place.dtype)[None], 1)
        self.own, self.ids, self.most = own, ids, len(ids)

    def collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """In how many arrays each vector lies in the window: from the windows' members while they are few, else from all places."""
        size = high - low
        if size.sum() * 8 < M * self.most:
            return np.bincount(np.concatenate([o[a:b] for o, a, b in zip(self.order, low, high, strict=True)]), minlength=self.most)
        kind = self.place.dtype
        inside = (self.place - low.astype(kind)[:, None]) < size.astype(kind)[:, None]  # wraps below the window
        return np.add.reduce(inside.view(np.uint8), 0, dtype=np.uint8)

    def search(self, q: np.ndarray, own_q: np.ndarray, query_id: int, scale: float, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of at most k rows. least: a score that k candidates are known to reach."""
        at = q @ self.a
        done = self.ids == query_id
        best_s, best_i = np.empty(0), np.empty(0, np.int64)
        need = math.floor(M * chance(WIDTH) - Z * math.sqrt(M * chance(WIDTH) * (1 - chance(WIDTH))))

        def last(bar: float) -> float:
            """The radius within which scores are bar or more."""
            return math.sqrt(max(2 * (1 - bar / scale), 0.0))

        radius = 0.4 if math.isinf(least) else max(last(least) / GROWTH, 1e-3)
        while True:
            low, high = self.flat.searchsorted(np.concatenate([at - WIDTH * radius, at + WIDTH * radius]).clip(-self.reach, self.reach) + self.rows).reshape(2, M) - self.begins
            whole = bool((low == 0).all() and (high == self.most).all())
            found = np.flatnonzero(~done & ((self.collisions(low, high) >= need) | whole))
            if len(found):
                done[found] = True
                scores = self.own[found] @ own_q if len(found) * 16 < self.most else (self.own @ own_q)[found]
                best_s = np.concatenate([best_s, scores])
                best_i = np.concatenate([best_i, self.ids[found]])
                if len(best_s) > 8 * k:  # keeps all that are as good as the k-th
                    some = np.flatnonzero(best_s >= np.partition(best_s, len(best_s) - k)[len(best_s) - k])
                    best_s, best_i = best_s[some], best_i[some]
                if len(best_s) > k:
                    top = np.lexsort((best_i, -best_s))[:k]
                    best_s, best_i = best_s[top], best_i[top]
            # at this radius, a vector scores scale * (1 - radius**2 / 2) or more
            bar = max(least, best_s.min() if len(best_s) >= k else -math.inf)
            if whole or (len(best_s) >= k and bar >= scale * (1 - radius * radius / 2)):
                return best_i, best_s
            radius = min(radius * GROWTH, last(bar) + 1e-9) if len(best_s) >= k else radius * GROWTH


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def bounded(asks: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """asks with least: the k-th best score among at most SAMPLE other vectors of the same dimension; null where these are too few."""
    few = v.orderBy(F.xxhash64("id"), "id").select("id", "dim", "v").limit(SAMPLE).collect()
    by: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r.dim for r in few}:
        by[dim] = np.array([r.id for r in few if r.dim == dim], np.int64), np.array([r.v for r in few if r.dim == dim], float)
    shared = v.sparkSession.sparkContext.broadcast(by)  # SAMPLE vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, ids, out = b.column("dim").to_numpy(), b.column("id").to_numpy(), np.full(len(b), np.nan)
            for dim in np.unique(dims).tolist():
                own, x = shared.value.get(dim, (np.empty(0, np.int64), None))
                if len(own) <= k:
                    continue
                at = np.flatnonzero(dims == dim)
                for part in np.array_split(at, max(1, len(at) // 256)):
                    s = matrix(b.column("v").take(pa.array(part)), dim) @ x.T
                    s[ids[part][:, None] == own[None]] = -np.inf
                    bar = np.partition(s, len(own) - k, 1)[:, len(own) - k]
                    out[part] = bar - 1e-9 * np.abs(bar)  # sums in another order may differ in the last places
            out[~np.isfinite(out)] = np.nan
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, from_pandas=True)], names=[*b.schema.names, "least"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asks.schema)
    return asks.mapInArrow(run, f"{kinds}, least double")


def search(vectors: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, least_block: int = LEAST_BLOCK) -> DataFrame:
    """(query_id, rank, id_col, score) of the k largest inner products of each row for which is_query holds."""
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    sane = F.col("id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    v = v.where(sane).withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).where("norm2 > 0").withColumn("dim", F.size("v"))
    v = v.withColumn("is_query", F.coalesce(is_query(F.col("id")), F.lit(False))).withColumn("place", F.monotonically_increasing_id())
    v = cut(v, "vectors")
    wide = v.sparkSession.sparkContext.defaultParallelism * 2
    n_blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / block), F.least(F.lit(wide), F.ceil(n / least_block))).cast("int")
    dims = v.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("int")).alias("nq"), F.max("norm2").alias("most"))
    dims = cut(dims.select("dim", "most", n_blocks(F.col("n")).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.col("nq") / block)).cast("int").alias("qblocks")), "dims")
    meetings = dims.agg(F.sum(F.col("blocks").cast("long") * F.col("qblocks"))).first()[0] or 1
    v = v.join(dims, "dim")
    mine = lambda n, salt: F.pmod(F.xxhash64("place", F.lit(salt)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["dim", "block", "qblock", "is_q", "id", "v", "most", "least"]
    none = F.lit(None).cast("double")
    data = v.withColumn("block", mine("blocks", 1)).withColumn("qblock", each("qblocks")).withColumn("is_q", F.lit(False)).withColumn("least", none).select(*columns)
    asks = bounded(v.where("is_query").select("dim", "id", "v", "most", "blocks", "qblocks", "place"), v, k)
    asks = asks.withColumn("qblock", mine("qblocks", 2)).withColumn("block", each("blocks")).withColumn("is_q", F.lit(True)).select(*columns)

    def met(held: list, most: float) -> Block | None:
        if not held:
            return None
        ids, own = np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held])
        unit = own / math.sqrt(most)
        return Block(np.column_stack([unit, np.sqrt(np.maximum(1 - (unit * unit).sum(1), 0))]), own, ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, index = None, [], None
        for b in batches:
            where = np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("dim", "block", "qblock", "is_q")], 1)
            starts = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(1))) if len(where) else []
            out = ([np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)])
            for a, e in zip(starts, [*starts[1:], len(where)], strict=True):
                part = b.slice(a, e - a)
                *this, is_q = where[a].tolist()
                if this != key:
                    key, held, index = this, [], None
                ids, x = part.column("id").to_numpy(), matrix(part.column("v"), this[0])
                if not is_q:
                    held.append((ids, x))
                    continue
                most = part.column("most")[0].as_py()
                if index is None:
                    index, held = met(held, most), []
                if index is None:
                    continue
                bars = part.column("least").to_numpy(zero_copy_only=False)
                for i, q, bar in zip(ids.tolist(), x, bars.tolist(), strict=True):
                    norm = float(np.linalg.norm(q))
                    found, scores = index.search(np.append(q / norm, 0.0), q, i, norm * math.sqrt(most), k, -math.inf if math.isnan(bar) else bar)
                    for c, y in zip(out, (np.full(len(found), i), found, scores), strict=True):
                        c.append(y)
            q, i, s = (np.concatenate(c) for c in out)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int64)), pa.array(i.astype(np.int64)), pa.array(s)], names=["query_id", "id", "score"])

    together = data.unionByName(asks).repartition(int(meetings), "dim", "block", "qblock").sortWithinPartitions("dim", "block", "qblock", "is_q")
    near = together.mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")


def brute(ids: np.ndarray, x: np.ndarray, queries: np.ndarray, k: int = 20) -> Iterator[tuple[int, list[int]]]:
    """The exact answer, for tests."""
    for i in queries:
        s = x @ x[np.flatnonzero(ids == i)[0]]
        s[ids == i] = -np.inf
        yield int(i), ids[np.lexsort((ids, -s))[:k]].tolist()


def op2_neighbours(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
