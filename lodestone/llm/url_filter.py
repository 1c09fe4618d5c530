"""URL filter: rules first, then the ratio of two character language models.

Urls that a rule decides are the labelled rows: two variable-order Markov models, of allowed and of blocked urls, are counted
from all of them. P(c | context of k characters) is mixed with that of k - 1 in proportion to how often the context was seen, so
unseen contexts fall back to shorter ones. The score of a url is the mean over its characters of the difference of
the models' log-likelihoods; Platt's sigmoid, fitted on labelled urls held out of the counts, turns it into a probability.

Counts are exact and grow with the urls: a table of distinct n-grams of the longest order, from which the shorter orders' follow. Up to
most_grams of them they go to every task, which is checked by counting; beyond, the urls' distinct n-grams are joined to the
tables of all orders. Both give the same scores. Equal urls are scored once.

Defined results: a null url, or one without "://", has empty host and path and no rule; a null or empty url scores 0, hence
the sigmoid's intercept decides; without labelled urls of both classes everything unruled is allowed. Repeated rows are
judged alike. Columns other than page_id and url aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: (host, start of path, verdict); the longest rule that fits wins.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Bytes before the one that is predicted; the longest n-gram, of one byte more, fits a long.
ORDER = 5
ALPHA = 2.0
#: Distinct n-grams up to which the model is sent to the tasks, about 60 bytes each in all orders.
MOST_GRAMS = 3_000_000


def _rest(url: Column) -> Column:
    """What follows the first ://; null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    raw = F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*", 0), F.lit(""))
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds host, path, rule and ruled (the rule's verdict; null without one)."""
    out = pages.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


def grams(urls: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Owner of each byte (its url's place), and the byte with the ORDER before it in one number, the byte lowest; zeros stand before the url."""
    raw = [u.lower().encode("utf-8", "replace") for u in urls]
    lens = np.fromiter(map(len, raw), np.int64, len(raw))
    owner = np.repeat(np.arange(len(raw)), lens)
    chars = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    at = np.arange(len(chars)) - np.repeat(np.cumsum(lens) - lens, lens)
    gram = chars.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(len(chars), np.int64)
        before[k:] = chars[:-k]
        before[at < k] = 0
        gram |= before << (8 * k)
    return owner, gram


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts (two columns)."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


class Ratio:
    """Exact counts (allowed, blocked) of n-grams of all orders and of their contexts, from those of the longest, and the sigmoid."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, slope: float = 1.0, shift: float = 0.0):
        self.slope, self.shift, self.orders = slope, shift, []
        for k in range(ORDER + 1):
            hits = added(keys & ((1 << 8 * (k + 1)) - 1), counts)
            self.orders.append((hits, added(hits[0] >> 8, hits[1])))

    @staticmethod
    def found(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        own, counts = table
        if not len(own):
            return np.zeros((len(keys), 2))
        at = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        return counts[at] * (own[at] == keys)[:, None]

    def ratios(self, keys: np.ndarray) -> np.ndarray:
        """Log-likelihood under the blocked model less that under the allowed one, of distinct grams."""
        p = np.full((len(keys), 2), 1 / 256)
        for k, (hits, contexts) in enumerate(self.orders):
            own = keys & ((1 << 8 * (k + 1)) - 1)
            p = (self.found(hits, own) + ALPHA * p) / (self.found(contexts, own >> 8) + ALPHA)
        return np.log(p[:, 1]) - np.log(p[:, 0])

    def score(self, urls: list[str]) -> np.ndarray:
        """Mean over the url's bytes."""
        owner, gram = grams(urls)
        kinds, back = np.unique(gram, return_inverse=True)
        n = np.maximum(np.bincount(owner, minlength=len(urls)), 1)
        return np.bincount(owner, self.ratios(kinds)[back], len(urls)) / n


def counted(known: DataFrame) -> DataFrame:
    """(gram, a, b): in how many places of allowed and of blocked urls each gram stands. Summed in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bad = b.column("bad").to_numpy(zero_copy_only=False)
            owner, gram = grams(b.column("url").to_pylist())
            keys, n = added(gram, np.stack([~bad[owner], bad[owner]], 1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n[:, 0]), pa.array(n[:, 1])], names=["gram", "a", "b"])

    return known.select("url", "bad").mapInArrow(run, "gram long, a long, b long").groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def model_of(counts: DataFrame, most_grams: int) -> Ratio | None:
    """The model in memory, if its distinct grams are most_grams at most."""
    if counts.limit(most_grams + 1).count() > most_grams:
        return None
    rows = counts.toArrow()
    return Ratio(rows.column("gram").to_numpy(), np.stack([rows.column(c).to_numpy() for c in ("a", "b")], 1).astype(np.float64))


def scored_by_model(urls: DataFrame, model: Ratio) -> DataFrame:
    """(url, score) of distinct urls; the model goes to every task."""
    shared = urls.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("url"), pa.array(shared.value.score(b.column("url").to_pylist()))], names=["url", "score"])

    return urls.select("url").mapInArrow(run, "url string, score double")


def scored_by_join(urls: DataFrame, counts: DataFrame) -> DataFrame:
    """(url, score) of distinct urls, for models of any size: the ratio of each distinct gram of the urls comes from joins with the
    tables of all orders; then each url sums those of its grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, gram = grams(b.column("url").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("url").take(pa.array(owner)), pa.array(gram)], names=["url", "gram"])

    places = cut(urls.select("url").mapInArrow(run, "url string, gram long"), "grams")
    out = places.select("gram").distinct().withColumn("pa", F.lit(1 / 256)).withColumn("pb", F.lit(1 / 256))
    for k in range(ORDER + 1):
        own = F.col("gram").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1))
        sums = lambda key, names: counts.groupBy(key.alias(names[0])).agg(F.sum("a").alias(names[1]), F.sum("b").alias(names[2]))
        hits, contexts = sums(own, ("h", "ha", "hb")), sums(F.shiftright(own, 8), ("c", "ca", "cb"))
        out = out.withColumn("h", own).withColumn("c", F.shiftright(own, 8)).join(hits, "h", "left").join(contexts, "c", "left")
        p = lambda x: (F.coalesce(f"h{x}", F.lit(0)) + ALPHA * F.col(f"p{x}")) / (F.coalesce(f"c{x}", F.lit(0)) + ALPHA)  # noqa: B023, E731
        out = cut(out.select("gram", p("a").alias("pa"), p("b").alias("pb")), "ratios")
    ratio = out.select("gram", (F.log("pb") - F.log("pa")).alias("ratio"))
    return places.join(ratio, "gram").groupBy("url").agg(F.avg("ratio").alias("score"))


def sigmoid(scored: DataFrame) -> tuple[float, float]:
    """Slope and intercept from labelled urls (score, bad), in bins of a fiftieth."""
    at = F.least(F.greatest(F.round(F.col("score") * 50), F.lit(-500.0)), F.lit(500.0)).cast("int")
    found = scored.groupBy(at.alias("bin"), "bad").count().collect()  # 1001 bins of two classes
    x, y, n = (np.array([float(v) for v in c]) for c in (zip(*((r.bin / 50, r.bad, r["count"]) for r in found), strict=True) if found else ((), (), ())))
    if not (0 < (y * n).sum() < n.sum()):
        return 0.0, -5.0
    a, b = 1.0, 0.0
    w = n * np.where(y > 0, n.sum() / (2 * (y * n).sum()), n.sum() / (2 * ((1 - y) * n).sum()))  # classes weigh alike
    for _ in range(100):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g, h = w * (p - y), w * p * (1 - p)
        grad = np.array([(g * x).sum() + 1e-2 * a, g.sum() + 1e-2 * b])
        hess = np.array([[(h * x * x).sum() + 1e-2, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-2]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def judge(pages: DataFrame, threshold: float = 0.5, rules=RULES, most_grams: int = MOST_GRAMS) -> DataFrame:
    """(page_id, host, path, rule, verdict, p_block): p_block is the calibrated probability, also where a rule decides.

    A fifth of the labelled urls, by hash, is kept out of the counts and calibrates the score.
    """
    ruled = cut(with_rule(pages.select("page_id", "url"), rules), "ruled")
    labelled = ruled.where(F.col("ruled").isNotNull() & F.col("url").isNotNull()).select("url", (F.col("ruled") == "block").alias("bad"))
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    counts = cut(counted(labelled.where(~held)), "counts")
    urls = ruled.where(F.col("url") != "").select("url").distinct()
    model = model_of(counts, most_grams)
    scores = cut(scored_by_join(urls, counts) if model is None else scored_by_model(urls, model), "scores")
    slope, shift = sigmoid(labelled.where(held).join(scores, "url"))
    out = ruled.join(scores, "url", "left").withColumn("p_block", 1 / (1 + F.exp(-(slope * F.coalesce("score", F.lit(0.0)) + shift))))
    verdict = F.coalesce("ruled", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "p_block")


def op3_url_filter(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", F.round("p_block", 6).alias("p_block"))
