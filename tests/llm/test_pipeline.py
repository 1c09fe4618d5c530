"""The pipeline's stages on a small table, each against what it must keep."""

from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import packing, pii


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    rng = np.random.default_rng(8)
    vocabulary = [f"w{i}" for i in range(3000)]
    good = lambda n: " ".join(rng.choice(vocabulary, n)) + " the of and. "
    texts = []
    for i in range(300):
        t = good(60)
        texts.append(" ".join(w.upper() + "%%%!!" for w in t.split()) if i % 6 == 0 else t + ". you vilething here" if i % 6 == 1 else t)
    texts += [texts[2], texts[2], texts[3] + " more", "mail a.b@c.org now " + good(40)]
    docs = [(i, t, "en", f"s{i % 3}", len(t), "extra") for i, t in enumerate(texts)] + [(2, texts[2], "en", "s2", len(texts[2]), "extra")]
    columns = "doc_id long, text string, lang string, source string, n_chars long, score string"
    spark.createDataFrame(docs, columns).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 != 0), int(i % 6 == 1)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    d, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        d = corpus_pipeline.cut(stage(spark, d, str(tmp_path)), name)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"]
        names.append({r.doc_id for r in d.collect()})
        if name == "near_duplicates":
            assert d.count() == len(names[-1])
    junk, toxic = {i for i in range(300) if i % 6 == 0}, {i for i in range(300) if i % 6 == 1}
    assert len(names[0] & junk) <= 2 and len(set(range(len(texts))) - junk - names[0]) <= 3
    assert len(names[1] & toxic) <= 2 and len(names[0] - toxic - names[1]) <= 3
    assert not names[2] & {300, 301, 302} and names[1] - names[2] == {300, 301, 302} & names[1]
    assert names[3] == names[2]
    redacted = {r.doc_id: r for r in d.collect()}
    assert redacted[303].text.startswith("mail [EMAIL] now") and redacted[303].n_chars == len(redacted[303].text)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    lengths = {}
    for r in out:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    t = packing.Ids(packing.tokenizer_path()).tokenizer
    assert lengths == {i: len(t.encode(r.text, add_special_tokens=False).ids) + 1 for i, r in redacted.items()}


def test_pipeline_of_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_personal_data_is_learnt_from_all_documents(spark, tmp_path):
    """Sixty right numbers among 30,000 documents are enough to learn from; half of them, which a sample of the documents holds, are not."""
    rng = np.random.default_rng(31)
    checked = lambda n: sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(n)))) % 10 == 0
    card = lambda: next(n for n in (str(rng.integers(10**15, 10**16)) for _ in range(10**6)) if checked(n))
    other = lambda: next(n for n in (str(rng.integers(10**15, 10**16)) for _ in range(10**6)) if not checked(n))
    two = f"{card()} {card()} both"
    texts = [f"sent with {card()} today" for _ in range(60)] + [f"sent with {other()} today" for _ in range(60)] + [two]
    some = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    plain = spark.range(1000, 31_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("plain words "), F.col("id").cast("string")).alias("text"))
    out = corpus_pipeline.pii_stage(spark, some.unionByName(plain.withColumn("n_chars", F.length("text").cast("long"))), str(tmp_path))
    assert out.count() == 30_121
    assert out.where("doc_id = 120").first().text == "[CARD] [CARD] both"
    assert all(r.text == "sent with [CARD] today" if r.doc_id < 60 else r.text == texts[r.doc_id] for r in out.where("doc_id < 120").collect())


def test_personal_data_is_learnt_from_both_halves_of_the_documents(spark, tmp_path):
    """Thirty right numbers are enough to learn from, though neither half of the documents holds the twenty that a threshold needs."""
    rng = np.random.default_rng(33)
    checked = lambda n: sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(n)))) % 10 == 0
    some = lambda right: next(n for n in (str(rng.integers(10**15, 10**16)) for _ in range(10**6)) if checked(n) == right)
    texts = [f"sent with {some(i < 30)} today" for i in range(60)] + [f"{some(True)} {some(True)} both"]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    x, counted = pii.described(docs)
    good = counted[x[:, 0] == 2][:, [1, 3]].sum(0)
    assert good.sum() == 32 and good.max() < 20  # the two of the last document would be numbers if they stood alone
    out = {r.doc_id: r.text for r in corpus_pipeline.pii_stage(spark, docs, str(tmp_path)).collect()}
    assert out == {i: "sent with [CARD] today" if i < 30 else t for i, t in enumerate(texts[:60])} | {60: "[CARD] [CARD] both"}


def test_texts_that_lie_through_later_stages_are_written_small(spark, tmp_path):
    rng = np.random.default_rng(32)
    vocabulary = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(vocabulary, 400)), "en", "s", 2800) for i in range(400)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    own = corpus_pipeline._apart(docs, "doc_id", "text", "source", "lang")
    judged = corpus_pipeline.quality.classify(own, corpus_pipeline.table(spark, str(tmp_path), "labels"), carry=True)
    size = lambda df: sum(Path(unquote(urlparse(f).path)).stat().st_size for f in df.inputFiles())
    assert judged.count() == 400
    assert size(judged.select("text")) < 0.8 * size(docs)
