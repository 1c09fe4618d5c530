"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its words; the document's score is their
noisy-or with a leak term, 1 - (1 - leak) * prod(1 - p_sentence), and that likelihood is what training on document labels
maximises. Sentence scores then tell which sentences offend. Sentences without a term that tells have no score, and the leak
takes up labels that no sentence explains, so a long clean text doesn't gather score from its length.

Defined results: null and empty texts have no sentence and score the leak; a text without letters likewise; repeated rows
and repeated ids are scored row by row; columns other than doc_id and text aren't read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, labelled_sample, small_batches

SENTENCE = re.compile(r"[^.!?\n]+[.!?]*")
WORD = re.compile(r"[^\W\d_]+")
#: Longer sentences are cut after so many words.
SENTENCE_WORDS = 64
#: Lengths of the word beginnings that count as terms.
BEGINNINGS = (4, 5, 6)
#: Words whose weight a task keeps at once.
KNOWN_WORDS = 150_000


@dataclass
class NoisyOr:
    """Weights of words and of word beginnings (with a leading ^), the sentences' intercept, and the leak."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -9.0
    leak: float = 0.02

    def sentence(self, words, known: dict[str, float]) -> float:
        """known: what words add, kept from sentence to sentence. A sentence without a term has no score."""
        z, any_term = self.bias, False
        for w in words:
            x = known.get(w)
            if x is None:
                if len(known) >= KNOWN_WORDS:
                    known.clear()
                x = known[w] = sum(self.weights.get(f, 0.0) for f in features(w))
            if x:
                z += x
                any_term = True
        return 1 / (1 + math.exp(-z)) if any_term and z > -30 else 0.0

    def document(self, scores) -> float:
        rest = 1 - self.leak
        for p in scores:
            rest *= 1 - p
        return 1 - rest


def features(word: str) -> list[str]:
    """The word, and its beginnings, which hold what inflected forms share."""
    return [word, *("^" + word[:k] for k in BEGINNINGS if k <= len(word))]


def sentences(text: str) -> Iterator[tuple[int, int, set[str]]]:
    """(start, end, words) of each piece with a word; offsets are code points."""
    for m in SENTENCE.finditer(text):
        part = m.group()
        words = WORD.findall(part.lower())
        if not words:
            continue
        if len(words) <= SENTENCE_WORDS:
            yield m.start(), m.end(), set(words)
            continue
        at = [(x.start(), x.end()) for x in WORD.finditer(part)]
        for i in range(0, len(at), SENTENCE_WORDS):
            run = at[i : i + SENTENCE_WORDS]
            a, b = run[0][0], run[-1][1]
            yield m.start() + a, m.start() + b, set(WORD.findall(part[a:b].lower()))


def telling_terms(rows: list[tuple[str, int]], max_terms: int, least: float) -> list[str]:
    """Terms found in toxic documents more often than chance explains: n * KL(share || base rate) of `least` nats or more."""

    def terms(text: str) -> set[str]:
        words: set[str] = set()
        for _, _, own in sentences(text):
            words |= own
        return {f for w in words for f in features(w)}

    base = min(max(sum(v for _, v in rows) / len(rows), 1e-6), 1 - 1e-6)
    hit = Counter()
    for text, v in rows:
        if v:
            hit.update(terms(text))
    able = {w for w, c in hit.items() if c * -math.log(base) >= least}  # the others fall short even if they are in no other document
    df = Counter()
    for text, _ in rows:
        df.update(able & terms(text))

    def nats(w: str) -> float:
        q = hit[w] / df[w]
        if q <= base:
            return 0.0
        return df[w] * (q * math.log(q / base) + ((1 - q) * math.log((1 - q) / (1 - base)) if q < 1 else 0.0))

    found = sorted((-x, w) for w in able if (x := nats(w)) >= least)
    return [w for _, w in found[:max_terms]]


def train(rows: list[tuple[str, int]], max_terms: int = 20_000, least: float = 14.0, rounds: int = 400, rate: float = 0.1, l2: float = 1e-5) -> NoisyOr:
    """Terms that tell, then Adam on the noisy-or likelihood of the documents' labels."""
    y = np.array([v for _, v in rows], float)
    rate_of_toxic = float(y.mean()) if rows else 0.02
    vocab = {w: i for i, w in enumerate(telling_terms(rows, max_terms, least))} if rows else {}
    if not vocab:
        return NoisyOr(leak=min(max(rate_of_toxic, 1e-3), 1 - 1e-3))
    col, row, owner = [], [], []
    for d, (text, _) in enumerate(rows):
        for _, _, s in sentences(text):
            ids = [vocab[f] for w in s for f in features(w) if f in vocab]
            if not ids:
                continue
            col += ids
            row += [len(owner)] * len(ids)
            owner.append(d)
    col, row, owner = np.array(col, np.int64), np.array(row, np.int64), np.array(owner, np.int64)
    n, m, k = len(rows), len(owner), len(vocab)
    theta = np.zeros(k + 2)
    theta[k], theta[k + 1] = -2.0, math.log(0.02 / 0.98)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        w, b, leak = theta[:k], theta[k], 1 / (1 + math.exp(-theta[k + 1]))
        z = np.clip(b + np.bincount(row, w[col], m), -40, 40)
        log_clean = math.log1p(-leak) - np.bincount(owner, np.logaddexp(0, z), n)
        toxic = np.clip(-np.expm1(log_clean), 1e-9, 1)
        pull = np.where(y > 0, -np.exp(log_clean) / toxic, 1.0)  # d loss / d(-log_clean)
        g = pull[owner] / (1 + np.exp(-z))
        grad = np.empty_like(theta)
        grad[:k] = np.bincount(col, g[row], k) / n + l2 * w
        grad[k] = g.sum() / n
        grad[k + 1] = (pull * leak).sum() / n
        m1 = 0.9 * m1 + 0.1 * grad
        m2 = 0.99 * m2 + 0.01 * grad**2
        theta = theta - rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-6)
        theta[k] = min(theta[k], -1.0)
    names = list(vocab)
    return NoisyOr({names[i]: float(theta[i]) for i in range(k)}, float(theta[k]), float(1 / (1 + math.exp(-theta[k + 1]))))


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 6000, keep=None, **how) -> NoisyOr:
    """Trained on at most max_docs labelled documents; `keep` filters the labels' doc_id before they are chosen."""
    return train(labelled_sample(docs, labels, "toxic", max_docs, keep), **how)


def score(docs: DataFrame, model: NoisyOr, offending: float = 0.5, threshold: float = 0.3, carry: bool = False) -> DataFrame:
    """(doc_id, score, predicted, spans): spans are the sentences with a score of `offending` or more, as start, end and score.

    With carry, all columns of docs come back, followed by the last three, whose names must then be free.
    """
    small_batches(docs.sparkSession)
    names = docs.columns if carry else ["doc_id"]
    source = docs if carry else docs.select("doc_id", "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names)
    schema = f"{kinds}, score double, predicted int, spans array<struct<start:int,end:int,score:double>>"
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, float] = {}
        for batch in batches:
            scores, spans = [], []
            for text in batch.column("text").to_pylist():
                found, each = [], []
                for a, b, words in sentences(text or ""):
                    p = model.sentence(words, known)
                    each.append(p)
                    if p >= offending:
                        found.append({"start": a, "end": b, "score": p})
                scores.append(model.document(each))
                spans.append(found)
            s = np.array(scores, float)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array(spans, kind)],
                names=[*names, "score", "predicted", "spans"],
            )

    return source.mapInArrow(run, schema)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learnt only from rows whose crc32(doc_id) mod 4 isn't 2."""
    from .common import table

    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels, keep=id_remainder(F.col("doc_id"), 4) != 2)
    out = score(docs, model)
    worst = F.try_element_at(F.array_sort("spans", lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).otherwise(a.start - b.start)), F.lit(1))
    return out.select(
        "doc_id", (id_remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted",
        F.size("spans").alias("n_offending"), worst.start.alias("worst_start"), worst.end.alias("worst_end"),
    )
