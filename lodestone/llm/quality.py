"""Quality classifier with hierarchical empirical Bayes over sites.

Evidence: boosted trees over shape features of the text, trained from a bounded sample of labels.quality, give each document a
log-odds of being good. Sites: a host (source) and its paths (source and language). A host's rate of good documents has a Beta
prior centred on the global rate, a path's one centred on its host's posterior; the priors' strengths come from the spread
of the observed rates (method of moments), so sites with few documents shrink to what stands above them. The document's own
evidence is left out of its site's posterior. Score = sigmoid(evidence + logit(path posterior) - logit(global rate)).

Texts are read once, to write each document's evidence; sums per path are pre-aggregated in each task, and only they are
shuffled. The sites' table is sent to the tasks if its rows are few, which is checked. Defined results: null and empty texts have
features of zero; null source or language is a site of its own; without labels of both kinds evidence is the global rate;
repeated rows each count. Columns other than doc_id, text, source and lang aren't read, and filtering keeps them.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, labelled_sample, small_batches
from .pii import at, boost

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "space": b" \t\r\n", "stop": b".", "comma": b",;:", "mark": b"!?", "bar": b"|<>{}[]()/\\=_~^", "symbol": b"#$%&*@+"}
N_FEATURES = len(CLASSES) + 9
#: Sites up to which their table goes to every task; about 100 bytes a row. Larger ones are joined by shuffle.
BROADCAST_SITES = 100_000


def features(texts: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), N_FEATURES))
    sets = [np.frombuffer(v, np.uint8) for v in CLASSES.values()]
    for row, text in zip(out, texts, strict=True):
        raw = (text or "").encode("utf-8", "replace")
        if not raw:
            continue
        seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
        row[: len(sets)] = [seen[s].sum() / len(raw) for s in sets]
        words, lines = raw.split(), raw.splitlines()
        kinds = Counter(words)
        n = max(len(words), 1)
        row[len(sets) :] = [
            math.log1p(len(words)), len(raw) / n, len(kinds) / n, max(kinds.values(), default=0) / n, 1 - len(set(lines)) / max(len(lines), 1),
            math.log1p(len(raw) / max(len(lines), 1)), sum(map(len, kinds)) / max(len(kinds), 1), seen[128:].sum() / len(raw), sum(len(w) > 20 for w in words) / n,
        ]
    return out


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, keep=None) -> tuple[float, list]:
    """(start, trees) of the document classifier, from at most max_docs labelled documents."""
    rows = labelled_sample(docs, labels, "quality", max_docs, keep)
    y = np.array([v for _, v in rows], float)
    if len(y) < 2 or y.min() == y.max():
        return math.log((y.sum() + 1) / (len(y) - y.sum() + 1)) if len(y) else 2.0, []
    return boost(features([t for t, _ in rows]), y, trees=40, depth=3, rate=0.2)


def with_evidence(docs: DataFrame, model: tuple[float, list], carry: bool) -> DataFrame:
    """Adds _z, the log-odds of the classifier; without carry only doc_id, source and lang come along."""
    start, trees = model
    small_batches(docs.sparkSession)
    source = docs if carry else docs.select("doc_id", "source", "lang", "text")
    names = [c for c in source.columns if carry or c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text").to_pylist())
            z = np.clip(start + sum((at(t, x) for t in trees), np.zeros(len(x))), -12, 12)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(z)], names=[*names, "_z"])

    return source.mapInArrow(run, f"{kinds}, _z double")


def site(c: str):
    return F.coalesce(F.col(c), F.lit("\x00none"))


def posteriors(evidence: DataFrame) -> DataFrame:
    """One row a path: _host, _path, n_path, good_path, host_rate (its host's posterior), strength and global_rate.

    A path's posterior is Beta with mean (good + strength * host_rate) / (n + strength).
    """
    p = 1 / (1 + F.exp(-F.col("_z")))
    paths = cut(evidence.groupBy(site("source").alias("_host"), site("lang").alias("_path")).agg(F.count("*").alias("n_path"), F.sum(p).alias("good_path")), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n_path").alias("n_host"), F.sum("good_path").alias("good_host"))
    m = hosts.agg(F.sum("n_host").alias("n"), F.sum("good_host").alias("g"), F.count("*").alias("k")).first()
    rate = min(max((m.g or 0.0) / m.n, 1e-3), 1 - 1e-3) if m.n else 0.5
    top = _strength(hosts, "n_host", "good_host", F.lit(rate), rate)
    hosts = hosts.withColumn("host_rate", (F.col("good_host") + top * rate) / (F.col("n_host") + top))
    both = paths.join(hosts.select("_host", "host_rate"), "_host")
    low = _strength(both, "n_path", "good_path", F.col("host_rate"), rate)
    return both.withColumn("strength", F.lit(low)).withColumn("global_rate", F.lit(rate))


def _strength(rows: DataFrame, n: str, good: str, centre, rate: float) -> float:
    """Pseudo-documents of the Beta prior around `centre` whose spread explains the rates' spread; between 2 and 10000."""
    r = rows.agg(
        F.sum(n).alias("n"), F.sum(F.col(n) * F.pow(F.col(good) / F.col(n) - centre, 2)).alias("ss"), F.count("*").alias("k")
    ).first()
    if not r.n or r.k < 2:
        return 50.0
    spread = rate * (1 - rate)
    between = r.ss / r.n - spread * r.k / r.n  # less what sampling alone makes
    return float(min(max(spread / between - 1, 2.0), 10_000.0)) if between > 1e-9 else 10_000.0


def score(evidence: DataFrame, sites: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds p_classifier, host_rate, path_rate, score and keep (score >= threshold) to the evidence's columns but _z."""
    p = 1 / (1 + F.exp(-F.col("_z")))
    logit = lambda c: F.log(c / (1 - c))
    tamed = lambda c: F.least(F.greatest(c, F.lit(1e-4)), F.lit(1 - 1e-4))
    few = sites.select("_host").limit(BROADCAST_SITES + 1).count() <= BROADCAST_SITES
    joined = evidence.withColumn("_host", site("source")).withColumn("_path", site("lang")).join(F.broadcast(sites) if few else sites, ["_host", "_path"])
    rate = tamed((F.col("good_path") - p + F.col("strength") * F.col("host_rate")) / (F.col("n_path") - 1 + F.col("strength")))
    out = joined.withColumn("p_classifier", p).withColumn("path_rate", rate)
    out = out.withColumn("score", 1 / (1 + F.exp(-(F.col("_z") + logit(F.col("path_rate")) - logit(F.col("global_rate"))))))
    return out.withColumn("keep", F.col("score") >= threshold).drop("_host", "_path", "_z", "n_path", "good_path", "strength", "global_rate")


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, carry: bool = False, **how) -> DataFrame:
    """Every document's score; with carry, all columns of docs come along, whose names must not be those of the scores."""
    model = fit(docs, labels, **how)
    evidence = cut(with_evidence(docs, model, carry), "evidence", "zstd" if carry else None)
    return score(evidence, posteriors(evidence), threshold)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", *(F.round(c, 6).alias(c) for c in ("p_classifier", "host_rate", "path_rate", "score")), "keep")
