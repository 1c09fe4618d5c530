"""Exact Jaccard self-join of documents' word shingles by token-combination prefixes, and its classes.

1. One pass hashes every document's set of 5-word shingles and counts shingles in a table of 2**SKETCH_BITS cells. The cell counts
   order the tokens (rare first, ties by hash) and tell frequent tokens from rare ones; any order gives right results.
   Documents with equal sets are one class, which its smallest doc_id represents.
2. A set of n tokens may miss at most n - ceil(0.8 n) of them in a partner. Its prefix is extended until its rare tokens,
   one each, and its frequent tokens, by sub-class one less than it holds there, add up to one more than that. Then a pair of
   similar sets shares a rare token or two frequent tokens of one sub-class in both prefixes: the keys are single rare tokens and pairs
   of frequent ones. The number of sub-classes follows the set's size band; a set is indexed for its own band and the next.
3. Each key's members are first compared with its most central member alone (the one with fewest rare tokens before the
   key); only pairs that this leaves in different stars, and whose sizes and positions allow 0.8, are compared next.
   Comparisons are on whole sets, streamed by hub, with hubs of many partners dealt out by salt.
4. Links between class representatives give the components by hash-to-min with pointer jumping. They span each component but
   aren't all of its links: members of one star don't meet. The number of links comes from comparing all classes of
   a component whose sizes allow 0.8, block by block; only each block's counts leave its task.

Tokens are compared by 64-bit hashes. Defined results: a null or empty text, or one without words, has the empty set and links
with nothing; fewer than five words are one token; repeated rows of a doc_id are one document, whose texts all count; a null
doc_id links with nothing and has no component; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, small_batches

SHINGLE = 5
SKETCH_BITS = 22
SLICE = 1 << 14
#: A token is frequent from this count above its cell's expected load on, plus FREQUENT_SIGMA times the load's deviation.
FREQUENT, FREQUENT_SIGMA = 32, 4.0
#: Classes that a task remembers as already indexed, and words whose hash it keeps.
KNOWN_SETS, KNOWN_WORDS = 200_000, 200_000
#: Members from which on a key counts as large.
LARGE_KEY = 24
#: Partners of a hub that one task compares.
HUB_PARTNERS = 4_000
#: Classes, and their tokens, in a block whose members are all compared for the number of links.
BLOCK_SETS, BLOCK_TOKENS = 500, 500_000

U = np.uint64
MULT = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD))
COMBINE = (U(0x94D049BB133111EB), U(0xBF58476D1CE4E5B9), U(0x2545F4914F6CDD1D))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    return x ^ (x >> U(29))


class Shingles:
    """Sorted distinct 64-bit tokens of a text's UTF-8 bytes. Words are runs without ASCII white space, A-Z lower-cased."""

    def __init__(self):
        from xxhash import xxh3_64_intdigest

        class Words(dict):
            def __missing__(self, w):
                if len(self) >= KNOWN_WORDS:
                    self.clear()
                v = self[w] = xxh3_64_intdigest(w)
                return v

        self.words = Words()

    def __call__(self, raw: bytes | None) -> np.ndarray:
        words = raw.lower().split() if raw else []
        if not words:
            return np.empty(0, np.uint64)
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(h)
        if n < SHINGLE:
            return mixed((h * np.array(MULT[:n], np.uint64)).sum(dtype=np.uint64, keepdims=True) + U(n))
        s = h[: n - 4] * MULT[0]
        for k in range(1, SHINGLE):
            s += h[k : n - 4 + k] * MULT[k]
        return np.unique(mixed(s))


def digest(s: np.ndarray) -> tuple[int, int]:
    from xxhash import xxh3_128_digest

    a, b = np.frombuffer(xxh3_128_digest(s.tobytes()), "<i8")
    return int(a), int(b)


# --- pass 1: sets' digests and the sketch --------------------------------------------------------------------------------------


def survey(docs: DataFrame) -> DataFrame:
    """Rows doc_id, n, h1, h2 for documents, and slice, counts (compressed) for the sketch."""
    cells = 1 << SKETCH_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, total = Shingles(), np.zeros(cells, np.uint32)
        names = ["doc_id", "n", "h1", "h2", "slice", "counts"]
        for b in batches:
            n, h1, h2 = [], [], []
            for raw in b.column("raw").to_pylist():
                s = shingles(raw)
                n.append(len(s))
                x, y = digest(s)
                h1.append(x)
                h2.append(y)
                np.add.at(total, (s & U(cells - 1)).astype(np.int64), np.uint32(1))
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int32()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        parts = [(i, zlib.compress(part.tobytes(), 1)) for i, part in enumerate(total.reshape(-1, SLICE)) if part.any()]
        for k in range(0, len(parts), 32):
            some = parts[k : k + 32]
            none = pa.nulls(len(some))
            yield pa.RecordBatch.from_arrays(
                [none.cast(pa.int64()), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), pa.array([i for i, _ in some], pa.int32()), pa.array([c for _, c in some], pa.binary())], names=names
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return source.mapInArrow(run, "doc_id long, n int, h1 long, h2 long, slice int, counts binary")


def ranks(found: DataFrame) -> np.ndarray:
    """One byte a cell: 0 to 127 rare, 128 and more frequent, higher for more counts. 2**SKETCH_BITS bytes whatever the input."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("slice").to_pylist(), b.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
                total[i] = total[i] + part if i in total else part
        keys = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([total[k].astype("<u8").tobytes() for k in keys], pa.binary())], names=["slice", "counts"])

    cells = np.zeros(1 << SKETCH_BITS, np.uint64)
    parts = found.where(F.col("slice").isNotNull()).select("slice", "counts")
    for r in parts.repartition(16, "slice").mapInArrow(add, "slice int, counts binary").toLocalIterator():
        cells[r.slice * SLICE : (r.slice + 1) * SLICE] = np.frombuffer(r.counts, "<u8")
    load = float(cells.sum()) / len(cells)
    limit = load + FREQUENT_SIGMA * load**0.5 + FREQUENT
    c = cells.astype(np.float64)
    rare = np.minimum(c / limit * 128, 127)
    return np.where(c < limit, rare, np.minimum(128 + np.log2(np.maximum(c / limit, 1)) * 8, 255)).astype(np.uint8)


# --- pass 2: prefixes ----------------------------------------------------------------------------------------------------------


def bands() -> np.ndarray:
    """Starts of the size bands; sizes within a ratio of 0.8 are in the same band or in neighbouring ones."""
    out = [1]
    while out[-1] < 1 << 31:
        out.append(-(-out[-1] * 5 // 4) if out[-1] > 4 else out[-1] + 1)
    return np.array(out, np.int64)


BANDS = bands()


def signatures(s: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions) of a set: rare tokens at their place in the order, pairs of frequent ones at the number of rare tokens."""
    n = len(s)
    need = n - -(-4 * n // 5) + 1
    r = rank[(s & U(len(rank) - 1)).astype(np.int64)]
    n_rare = int((r < 128).sum())
    order = np.lexsort((s, r))
    rare = s[order[: min(n_rare, need)]]
    keys, places = [rare], [np.arange(len(rare), dtype=np.int32)]
    short = need - n_rare
    if short > 0:
        frequent = s[order[n_rare:]]
        own = int(np.searchsorted(BANDS, n, "right")) - 1
        for band in (own, own + 1):
            low = int(BANDS[max(band - 1, 0)])
            groups = low * 3 // 10
            if groups < 2:  # small sets: single tokens, told apart from rare ones by the band
                part = mixed(frequent * COMBINE[0] + U(band))
                keys.append(part)
                places.append(np.full(len(part), n_rare, np.int32))
                continue
            group = (mixed(frequent + U(band)) % U(groups)).astype(np.int64)
            # the place of each token within its group, in the order: beyond the first, each adds one
            by = np.argsort(group, kind="stable")
            g = group[by]
            first = np.concatenate(([0], np.flatnonzero(g[1:] != g[:-1]) + 1)) if len(g) else np.empty(0, np.int64)
            runs = np.diff(np.append(first, len(g)))
            inside = np.empty(len(g), np.int64)
            inside[by] = np.arange(len(g)) - np.repeat(first, runs)
            gained = np.cumsum(inside > 0)
            end = int(np.searchsorted(gained, short)) + 1  # tokens of the prefix; all of them reach `short` by the choice of groups
            group, tokens = group[:end], frequent[:end]
            by = np.argsort(group, kind="stable")
            g, t = group[by], tokens[by]
            span = 1
            while span < len(g):
                same = g[span:] == g[:-span]
                if not same.any():
                    break
                a, b = t[:-span][same], t[span:][same]
                part = mixed(np.minimum(a, b) * COMBINE[0] + np.maximum(a, b) * COMBINE[1] + U(band * int(COMBINE[2]) & (1 << 64) - 1))
                keys.append(part)
                places.append(np.full(len(part), n_rare, np.int32))
                span += 1
    return np.concatenate(keys), np.concatenate(places)


def index(docs: DataFrame, rank: np.ndarray) -> DataFrame:
    """Rows key, doc_id, n, at. A class met again in the same task isn't indexed again."""
    shared = docs.sparkSession.sparkContext.broadcast(rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, rank, seen = Shingles(), shared.value, set()
        for b in batches:
            keys, ids, sizes, places, held = [], [], [], [], 0
            for i, raw in zip(b.column("doc_id").to_pylist(), b.column("raw").to_pylist(), strict=True):
                s = shingles(raw)
                if not len(s):
                    continue
                d = digest(s)
                if d in seen:
                    continue
                if len(seen) >= KNOWN_SETS:
                    seen.clear()
                seen.add(d)
                k, p = signatures(s, rank)
                keys.append(k)
                places.append(p)
                ids.append(np.full(len(k), i, np.int64))
                sizes.append(np.full(len(k), len(s), np.int32))
                held += len(k)
                if held > 200_000:
                    yield batch(keys, ids, sizes, places)
                    keys, ids, sizes, places, held = [], [], [], [], 0
            if keys:
                yield batch(keys, ids, sizes, places)
            pa.default_memory_pool().release_unused()

    def batch(keys, ids, sizes, places):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(np.concatenate(c)) for c in (ids, sizes, places))], names=["key", "doc_id", "n", "at"])

    source = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return source.mapInArrow(run, "key long, doc_id long, n int, at int")


def allowed(n1: str, at1: str, n2: str, at2: str):
    """Sizes and positions leave room for an overlap of 4/9 of both sizes, which is what 0.8 takes."""
    a, b = F.col(n1), F.col(n2)
    return (F.least(a, b) * 5 >= F.greatest(a, b) * 4) & (F.least(a - F.col(at1), b - F.col(at2)) * 9 >= (a + b) * 4)


# --- comparison ----------------------------------------------------------------------------------------------------------------


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, tokens) of the wanted classes (rep, h1, h2), once each; other columns of wanted go along."""
    carried = wanted.drop("rep", "h1", "h2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for b in batches:
            kept, out = [], []
            for k, (raw, h1, h2) in enumerate(zip(*(b.column(c).to_pylist() for c in ("raw", "h1", "h2")), strict=True)):
                s = shingles(raw)
                if digest(s) == (h1, h2):
                    kept.append(k)
                    out.append(s.tobytes())
            some = b.take(pa.array(kept, pa.int32()))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(out, pa.binary()), *(some.column(c) for c in names)], names=["doc_id", "tokens", *names])

    names = carried.columns
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in carried.schema)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return source.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").mapInArrow(run, f"doc_id long, tokens binary{kinds}")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (hub, member) that are similar. Members stream past their hub's set; a hub with many is dealt out by salt."""
    heavy = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_PARTNERS).cast("int").alias("salts"))
    salted = pairs.join(heavy, "hub").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("salts")).cast("int"))
    members = salted.join(sets.withColumnRenamed("doc_id", "member"), "member").select("hub", "salt", "member", "tokens")
    hubs = heavy.join(sets.withColumnRenamed("doc_id", "hub"), "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("member"), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, own = None, None
        for b in batches:
            found = []
            for hub, salt, member, raw in zip(*(b.column(c).to_pylist() for c in ("hub", "salt", "member", "tokens")), strict=True):
                s = np.frombuffer(raw, np.uint64)
                if member is None:
                    key, own = (hub, salt), s
                elif key == (hub, salt):
                    n = len(own) + len(s)
                    if 5 * min(len(own), len(s)) >= 4 * max(len(own), len(s)):
                        small, big = (own, s) if len(own) < len(s) else (s, own)
                        at = np.minimum(np.searchsorted(big, small), len(big) - 1)
                        both = int((big[at] == small).sum())
                        if 100 * both >= 80 * (n - both):
                            found.append((hub, member))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["hub", "member"])

    both = hubs.unionByName(members)
    together = both.repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    return together.mapInArrow(run, "hub long, member long")


def components(links: DataFrame, name: str, most: int = 60) -> DataFrame:
    """(node, component) of the nodes in links (a, b): the smallest node that can be reached."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    edges = cut(both.union(both.select("v", "u")).distinct(), f"{name}-edges")
    labels = cut(edges.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), f"{name}-labels")
    for _ in range(most):
        near = edges.join(labels, edges.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        step = cut(step.join(jump, "next").select("node", "component", F.least("next", "far").alias("next")), f"{name}-labels")
        done = step.where(F.col("next") != F.col("component")).limit(1).count() == 0
        labels = step.select("node", F.col("next").alias("component"))
        if done:
            return labels
    raise RuntimeError("components did not settle")


def degrees(docs: DataFrame, info: DataFrame, labels: DataFrame) -> DataFrame:
    """(h1, h2, n_links): with how many other classes each is similar. Similar classes are of one component and of equal or neighbouring bands."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.3))).cast("int")
    reps = info.where(F.col("doc_id") == F.col("rep")).select("rep", "n", "h1", "h2").distinct()
    members = reps.join(labels.withColumnRenamed("node", "rep"), "rep").withColumn("band", band)
    sums = members.groupBy("component", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK_SETS, F.sum("n") / BLOCK_TOKENS)).cast("int").alias("blocks"), F.count("*").alias("c"))
    sums = cut(sums, "blocks")
    above = sums.select("component", (F.col("band") - 1).alias("band"), F.col("blocks").alias("blocks_above"))
    below = sums.select("component", (F.col("band") + 1).alias("band"), F.col("blocks").alias("blocks_below"))
    dealt = members.join(sums, ["component", "band"]).join(above, ["component", "band"], "left").join(below, ["component", "band"], "left")
    me = F.pmod(F.xxhash64("h1", "h2"), F.col("blocks")).cast("int")
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    unit = lambda low, x, high, y, right: F.struct(low.alias("low"), x.alias("x"), high.alias("high"), y.alias("y"), F.lit(right).alias("right"))
    own, mine = F.col("band"), F.col("me")
    no = lambda c: F.coalesce(F.col(c), F.lit(0))
    units = F.concat(
        F.transform(F.filter(numbers(F.when(F.col("c") > 1, F.col("blocks")).otherwise(0)), lambda k: k >= mine), lambda k: unit(own, mine, own, k, False)),
        F.transform(F.filter(numbers(F.col("blocks")), lambda k: k < mine), lambda k: unit(own, k, own, mine, True)),
        F.transform(numbers(no("blocks_above")), lambda k: unit(own, mine, own + 1, k, False)),
        F.transform(numbers(no("blocks_below")), lambda k: unit(own - 1, k, own, mine, True)),
    )
    wanted = dealt.withColumn("me", me).select("rep", "h1", "h2", "component", F.col("h1").alias("d1"), F.col("h2").alias("d2"), units.alias("units")).where(F.size("units") > 0)
    rows = sets_of(docs, wanted).select("component", F.explode("units").alias("u"), "d1", "d2", "tokens").select("component", "u.*", "d1", "d2", "tokens")
    names = ["component", "low", "x", "high", "y"]

    def counted(lefts: list, rights: list) -> Iterator[tuple[tuple[int, int], int]]:
        """(digest, links) from all pairs of a left and a right set, or of two left sets where no block is to the right."""
        others = rights or lefts
        if not lefts or len(lefts) + len(rights) < 2:
            return
        every = [s for _, s in others]
        size = np.array([len(s) for s in every])
        words, codes = np.unique(np.concatenate(every), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(size)[:-1]))
        back, held = np.zeros(len(others), np.int64), np.zeros(len(words), np.int32)
        for k, (own, s) in enumerate(lefts):
            at = np.minimum(np.searchsorted(words, s), len(words) - 1)
            at = at[words[at] == s]
            held[at] = 1
            both = np.add.reduceat(held[codes], starts)
            held[at] = 0
            hit = 100 * both >= 80 * (len(s) + size - both)
            if not rights:
                hit[k] = False
            back += hit
            if hit.any():
                yield own, int(hit.sum())
        if rights:
            yield from ((own, int(n)) for (own, _), n in zip(rights, back, strict=True) if n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lefts, rights = None, [], []

        def told(pairs):
            pairs = list(pairs)
            return pa.RecordBatch.from_arrays([pa.array([v[0] for v, _ in pairs], pa.int64()), pa.array([v[1] for v, _ in pairs], pa.int64()), pa.array([n for _, n in pairs], pa.int64())], names=["h1", "h2", "links"])

        for b in batches:
            found = []
            for *unit, right, d1, d2, raw in zip(*(b.column(c).to_pylist() for c in (*names, "right", "d1", "d2", "tokens")), strict=True):
                if unit != key:
                    if key is not None and (rights or key[1:3] == key[3:]):
                        found.extend(counted(lefts, rights))
                    key, lefts, rights = unit, [], []
                side = rights if right else lefts
                if not side or side[-1][0] != (d1, d2):  # a repeated row comes next to its first
                    side.append(((d1, d2), np.frombuffer(raw, np.uint64)))
            yield told(found)
        if key is not None and (rights or key[1:3] == key[3:]):
            yield told(counted(lefts, rights))

    together = rows.repartition(*names).sortWithinPartitions(*names, "right", "d1", "d2")
    return together.mapInArrow(run, "h1 long, h2 long, links long").groupBy("h1", "h2").agg(F.sum("links").alias("n_links"))


def join(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(info, spanning, labels): doc_id, n, rep of every document with an id; links (a, b) between representatives that span
    the components (not all links, see degrees); the components of those."""
    small_batches(docs.sparkSession)
    seen = cut(survey(docs), "survey")
    rank = ranks(seen)
    info = seen.where(F.col("slice").isNull()).select("doc_id", "n", "h1", "h2")
    solid = info.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
    classes = solid.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    several = classes.where(F.col("copies") > 1).select("h1", "h2", "rep")
    info = info.join(several, ["h1", "h2"], "left").withColumn("rep", F.when(F.col("n") > 0, F.coalesce("rep", "doc_id")))
    info = cut(info, "classes")
    rep = info.where(F.col("rep").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "rep").distinct()


    whole = Window.partitionBy("key")
    rows = index(docs, rank).select("key", F.struct("at", "n", "doc_id").alias("m"))
    rows = rows.withColumn("hub", F.min("m").over(whole)).withColumn("last", F.max("m").over(whole)).where(F.col("hub") != F.col("last"))
    rows = cut(rows.select("key", "m.*", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at")), "postings")

    renamed = {s: rep.select(F.col("doc_id").alias(s), F.col("rep").alias(f"{s}_rep")) for s in ("hub", "doc_id")}
    stars = rows.where((F.col("hub") != F.col("doc_id")) & allowed("n", "at", "hub_n", "hub_at")).select("hub", "doc_id").distinct()
    stars = stars.join(renamed["hub"], "hub").join(renamed["doc_id"], "doc_id").select(F.col("hub_rep").alias("hub"), F.col("doc_id_rep").alias("member"))
    stars = cut(stars.where(F.col("hub") != F.col("member")).distinct(), "stars")
    digests = info.where(F.col("doc_id") == F.col("rep")).select("rep", "h1", "h2").distinct()

    def compared(pairs: DataFrame, name: str) -> DataFrame:
        ends = pairs.select(F.col("hub").alias("rep")).union(pairs.select("member")).distinct()
        sets = sets_of(docs, digests.join(ends, "rep"))
        return cut(similar(pairs, cut(sets, f"{name}-sets")).distinct(), name)

    first = compared(stars, "first")
    # a class goes by the hub, among those it is linked with and itself, that has most links
    fame = first.groupBy("hub").agg(F.count("*").alias("fame"))
    near = first.join(fame, "hub").select(F.col("member").alias("rep"), "hub", "fame").union(fame.select(F.col("hub").alias("rep"), "hub", "fame"))
    star = cut(near.groupBy("rep").agg(F.max_by("hub", F.struct("fame", "hub")).alias("star")), "star")
    sized = info.where(F.col("rep").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "n", "rep").distinct()
    named = sized.join(star, "rep", "left").select("doc_id", "n", "rep", F.coalesce("star", "rep").alias("star"))
    marked = rows.select("key", "doc_id", "n", "at").join(named, ["doc_id", "n"])
    by_rep = marked.groupBy("key", "rep").agg(F.first("star").alias("star"), F.min("n").alias("n"), F.min("at").alias("at"))
    # of each key, its largest star, whose members needn't meet each other; rows that no partner's size suits go
    sums = by_rep.groupBy("key", "star").agg(F.count("*").alias("c"), F.min("n").alias("least"))
    tops = sums.groupBy("key").agg(F.max_by("star", F.struct("c", "star")).alias("top"), F.sum("c").alias("size"), F.count("*").alias("stars"), F.min("least").alias("least")).where("stars > 1")
    suits = (F.col("n") - F.col("at")) * 9 >= (F.col("n") + F.greatest(F.col("least"), F.ceil(F.col("n") * 4 / 5))) * 4
    left = cut(by_rep.join(tops, "key").where(suits).drop("least", "stars"), "apart")
    # a pair that shares many large keys is made at the first of them in the tokens' order: positions bound the overlap only there.
    # Ids with several texts mix the texts' places, so their pairs are made at every key.
    many = rep.groupBy("doc_id").agg(F.collect_set("rep").alias("reps")).where(F.size("reps") > 1)
    mixed_up = many.select(F.explode("reps").alias("rep")).distinct()
    large = left.where(F.col("size") >= LARGE_KEY).groupBy("rep").agg(F.transform(F.array_sort(F.collect_set(F.struct("at", "key"))), lambda k: k["key"]).alias("large"))
    left = left.join(large.join(mixed_up, "rep", "left_anti"), "rep", "left")
    a, b = left.where(F.col("star") != F.col("top")), left.select("key", *(F.col(c).alias(f"{c}2") for c in ("rep", "star", "n", "at", "large")))
    once = (F.col("rep") != F.col("rep2")) & (F.col("star") != F.col("star2")) & ((F.col("star2") == F.col("top")) | (F.col("rep") < F.col("rep2")))
    first_key = (F.col("size") < LARGE_KEY) | F.col("large").isNull() | F.col("large2").isNull() | (F.get(F.array_intersect("large", "large2"), F.lit(0)) == a.key)
    pairs = a.join(b, (a.key == b.key) & once & allowed("n", "at", "n2", "at2") & first_key)
    pairs = pairs.select(F.least("rep", "rep2").alias("hub"), F.greatest("rep", "rep2").alias("member")).distinct()
    known = first.select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member"))
    tried = stars.select(F.least("hub", "member").alias("hub"), F.greatest("hub", "member").alias("member")).distinct()
    second = compared(cut(pairs.join(tried, ["hub", "member"], "left_anti"), "pairs"), "second")

    # repeated ids with different texts
    same = many.select(F.array_min("reps").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    links = known.union(second).select(F.col("hub").alias("a"), F.col("member").alias("b")).union(same)
    links = cut(links, "links")
    return info, links, components(links, "near")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, n_links): one row per row of docs; n_links counts all other classes similar to its own."""
    info, _, labels = join(docs)
    degree = degrees(docs, info, labels)
    out = info.join(labels.withColumnRenamed("node", "rep"), "rep", "left").join(degree, ["h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import table

    return classes(table(spark, sf_dir, "documents"))
