"""Each operator on small tables against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard_join, media, neighbours, packing, pieces, pii, quality, sharding, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, keep string"


def docs(spark, texts, ids=None):
    rows = [(ids[i] if ids else i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t or ""), 0.5, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


ODD = [None, "", " ", "one", "word " * 30_000, "x" * 20_000, "é\U0001f600 ñ\u2028z", "+1 (017) 555-7713 a@b.co", "1" * 9000, "\x00\x1c"]


def words(rng, n):
    return " ".join(rng.choice([f"w{i}" for i in range(3000)], n))


# --- near duplicates


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        s = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        sets.setdefault(i, []).append(s)
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    texts = list(ODD)
    for n in (5, 7, 12, 40, 150):
        base = words(rng, n).split()
        for k in range(30):  # a group of near copies with ever more edits
            w = list(base)
            for at in rng.integers(0, n, k % 6):
                w[at] = f"e{rng.integers(1e9)}"
            texts.append(" ".join(w))
    texts += [words(rng, 60) for _ in range(40)]
    texts += [texts[20]] * 6 + [texts[21].upper()]
    ids = list(range(100, 100 + len(texts)))
    ids[-1] = ids[30]  # a repeated id with another text
    out = jaccard_join.classes(docs(spark, texts, ids)).collect()
    want = brute_components(list(zip(ids, texts, strict=True)))
    assert len(out) == len(texts)
    assert {r.doc_id: r.component_id for r in out} == want
    assert len(set(want.values())) < len(want)


def test_components_with_every_token_frequent(spark, monkeypatch):
    """All keys are then pairs of tokens."""
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)
    monkeypatch.setattr(jaccard_join, "FREQUENT_SIGMA", 0.0)
    rng = np.random.default_rng(6)
    base = [words(rng, n).split() for n in (9, 30, 80)]
    texts = [" ".join(w if rng.random() > 0.01 * (k % 5) else f"e{k}" for w in b) for b in base for k in range(25)]
    out = jaccard_join.classes(docs(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_components(list(enumerate(texts)))


def overlapping(rng, n, step, size=104):
    """Windows over one long text, so that each is similar to its neighbours only, with some private words."""
    long = words(rng, n * step + size + 40).split()
    return [" ".join([f"p{k}x{j}" for j in range(k % 5)] + long[k * step : k * step + size + int(rng.integers(-6, 7))]) for k in range(n)]


def test_components_of_overlapping_groups_of_varying_length(spark, monkeypatch):
    """Pairs that share only large keys meet at the first of them, where the positions allow it."""
    monkeypatch.setattr(jaccard_join, "LARGE_KEY", 3)
    rng = np.random.default_rng(11)
    texts = [t for step in (3, 4, 5, 6, 7, 8) for t in overlapping(rng, 110, step)]
    out = jaccard_join.classes(docs(spark, texts)).collect()
    assert {r.doc_id: r.component_id for r in out} == brute_components(list(enumerate(texts)))


@pytest.mark.parametrize("block", [500, 7])
def test_links_equal_brute_force(spark, monkeypatch, block):
    """The number of links counts every similar class, also within a star, whatever the blocks."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", block)
    rng = np.random.default_rng(12)
    base = words(rng, 120).split()
    texts = [" ".join(w if rng.random() > 0.004 * (k % 5) else f"e{k}x{j}" for j, w in enumerate(base)) for k in range(60)]
    texts += overlapping(rng, 40, 4) + [texts[0], None, "", "one two", "one two"] + [words(rng, 50)] * 2
    ids = list(range(len(texts)))
    ids[-3] = ids[5]  # a repeated id with another text
    shingles = lambda t: frozenset(tuple(w[k : k + 5]) for w in [(t or "").split()] for k in range(max(len(w) - 4, bool(w))))
    sets = {i: shingles(t) for i, t in zip(ids, texts, strict=True) if i != ids[5]}
    every = {shingles(t) for t in texts} - {frozenset()}
    want = {i: sum(100 * len(s & x) >= 80 * len(s | x) for x in every if x != s) for i, s in sets.items()}
    out = jaccard_join.classes(docs(spark, texts, ids)).collect()
    assert {r.doc_id: r.n_links for r in out if r.doc_id != ids[5]} == want
    assert len(out) == len(texts) and max(want.values()) > 20


def test_components_of_nothing(spark):
    assert jaccard_join.classes(docs(spark, [])).collect() == []
    out = jaccard_join.classes(docs(spark, [None, "a b", "a b"], [None, 7, 7])).collect()
    assert sorted((r.doc_id or -1, r.component_id) for r in out if r.doc_id) == [(7, 7), (7, 7)]


# --- personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in PATTERNS for m in re.finditer(p, text or "") if ok(m.group())]


def test_base_spans_equal_the_patterns(spark):
    rng = np.random.default_rng(2)
    parts = ["a@b.c", "a@b.c_d@e.f", "x.y@z", "é@a.b.c", "1.2.3.4.5.6.7.8", "300.1.2.3.4", "0255.1.1.1", "4111 1111-1111 1111", "4111111111111112", "1" * 25, "5", "5 5", "+1 (017) 555-7713", "+123", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++1 555 000 1111", " ", "-", "\U0001f600", "..", "%+-@", "@@", "\n"]
    texts = ODD + ["".join(rng.choice(parts, 12)) for _ in range(300)]
    out = {r.doc_id: r for r in pii.find(docs(spark, texts), (0.0, [], [])).select("doc_id", pii.joined(F.col("_base")).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert out[i].s == ",".join(base(t)), t


def test_candidates_like_the_known_are_added_and_base_stays(spark):
    texts = [f"mail: {'ann' if i % 2 else f'n{i}'}@{'host' if i % 3 else f'h{i % 7}'}.org, or call {i}" for i in range(300)] + [f"at x{i}@home and {i} 22" for i in range(200)] + ["mail: josé@höst.org."] * 3  # the known pattern takes ASCII only
    d = docs(spark, texts)
    model = pii.fit(docs(spark, texts[:500]))
    out = pii.find(d, model).select("doc_id", pii.joined(F.col("_base")).alias("b"), pii.joined(F.col("_spans")).alias("s")).collect()
    assert all(set(filter(None, r.b.split(","))) <= set(r.s.split(",")) for r in out)
    assert sum(r.s != r.b for r in out if r.doc_id >= 500) == 3
    assert all(r.s == r.b for r in out if 300 <= r.doc_id < 500)
    red = {r.doc_id: r.text for r in pii.redact(d, model).collect()}
    assert red[0] == "mail: [EMAIL], or call 0" and red[501] == "mail: [EMAIL]." and red[300] == texts[300]


def test_candidates_in_compound_runs_and_secrets_are_added(spark):
    rng = np.random.default_rng(21)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(200)]
    card = lambda: next(n for n in (str(rng.integers(10**15, 10**16)) for _ in range(10**6)) if luhn_ok(n))
    texts = [f"sent with {card()} today and {rng.integers(10**15, 10**16) // 2 * 2} too" for _ in range(200)] + [f'the token = "{h}" is longwordwithoutdigits{i}' for i, h in enumerate(hexes)]
    extra = [f"{card()} {card()} both", f'plain "{hexes[0][::-1]}" alone', "antidisestablishmentarianism"]
    d = docs(spark, texts + extra)
    out = {r.doc_id: r for r in pii.find(d, pii.fit(d)).select("doc_id", pii.joined(F.col("_base")).alias("b"), pii.joined(F.col("_spans")).alias("s")).collect()}
    assert out[400].b == "" and out[400].s == "card:0:16,card:17:33"
    assert out[401].s == "secret:7:47" and out[402].s == ""
    assert all(out[200 + i].s == "secret:13:53" for i in range(200))
    for i in range(200):
        assert out[i].s == out[i].b


def luhn_ok(n):
    return sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(map(int, reversed(n)))) % 10 == 0


def test_trees_as_columns_equal_trees(spark):
    rng = np.random.default_rng(22)
    x = rng.integers(0, 6, (400, pii.N_FEATURES))
    start, trees = pii.boost(x.astype(float), ((x[:, 1] + x[:, 4] > 5) ^ (x[:, 7] > 3)).astype(float))
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, x array<int>")
    got = {r.i: r.z for r in rows.select("i", pii.log_odds(F.col("x"), start, trees).alias("z")).collect()}
    want = start + sum(pii.at(t, x.astype(float)) for t in trees)
    assert [got[i] for i in range(400)] == pytest.approx(want.tolist())


def test_running_and_redaction_of_many_spans(spark):
    texts = ["ü a@b.co, " * 3000, "no", "+1 (017) 555-7713 a@b.co"]
    out = {r.doc_id: r.text for r in pii.redact(docs(spark, texts), (0.0, [], [])).collect()}
    assert out == {0: "ü [EMAIL], " * 3000, 1: "no", 2: "[PHONE] [EMAIL]"}


def test_all_candidates_of_all_documents_are_learnt_from(spark):
    n = 30_000  # more documents, and more candidates of a generator, than a sample held before
    d = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("write to u"), F.col("id").cast("string"), F.lit("@host.org now")).alias("text"))
    d = d.union(spark.createDataFrame([(n + i, f"write to ann{i}@home now") for i in range(40)], "doc_id long, text string"))
    _, counted = pii.described(d)
    assert counted[:, [0, 2]].sum() == n + 40 and counted[:, [1, 3]].sum() == n
    _, again = pii.described(d.union(d).repartition(7))
    assert (again == 2 * counted).all()


def test_no_documents_no_spans(spark):
    assert pii.find(docs(spark, [])).count() == 0


# --- packing, sharding, pieces


def test_packing_round_trip(spark):
    texts = [*ODD, "Same text here", "Same text here"]
    path = packing.tokenizer_path()
    out = packing.pack(docs(spark, texts), path).collect()
    t = packing.Ids(path).tokenizer
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    for i, text in enumerate(texts):
        own = sorted(by[i], key=lambda r: r.start)
        ids = np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist()
        assert ids == [*t.encode(text or "", add_special_tokens=False).ids, 1]
        assert all(r.length & (r.length - 1) == 0 and r.doc_tokens == len(ids) and r.offset == 0 and zlib.crc32(r.ids) == r.ids_crc32 for r in own)
    assert sorted(r.sequence_id for r in out) == list(range(len(out)))
    assert packing.pack(docs(spark, []), path).count() == 0


@pytest.mark.parametrize("bucket_rows", [20_000, 3])
def test_shards_are_contiguous_and_even(spark, bucket_rows):
    rng = np.random.default_rng(3)
    texts = [*ODD[:4], *("same" for _ in range(60)), *(words(rng, int(n)) for n in rng.integers(1, 60, 150))]
    out = sharding.prefix_shards(sharding.with_size(docs(spark, texts)), 7, bucket_rows).collect()
    assert sorted(r.doc_id for r in out) == list(range(len(texts)))
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw)
    rows = sorted(out, key=lambda r: r.start)
    assert [r.start for r in rows] == np.concatenate(([0], np.cumsum([r["size"] for r in rows])[:-1])).tolist()
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for k in range(7):
        own = [r for r in rows if r.shard == k]
        assert abs(sum(r["size"] for r in own) - total / 7) <= largest and [r.slot for r in own] == list(range(len(own)))


@pytest.mark.parametrize("part_rows", [5, 40])
def test_equal_texts_lie_together_in_parts_of_any_size(spark, part_rows):
    rng = np.random.default_rng(12)
    texts = [f"text {rng.integers(0, 300)}" for _ in range(900)] + ["hot"] * 700 + [None] * 90 + [""] * 60
    out = sharding.prefix_shards(sharding.with_size(docs(spark, texts, [i if i % 7 else None for i in range(len(texts))])), 6, part_rows).select("start", "size", "text_crc32", "shard", "slot").collect()
    rows = sorted(out, key=lambda r: r.start)
    assert [r.start for r in rows] == np.concatenate(([0], np.cumsum([r.size for r in rows])[:-1])).tolist()
    crcs = [r.text_crc32 for r in rows]
    assert 1 + sum(a != b for a, b in zip(crcs, crcs[1:], strict=False)) == len(set(crcs))
    assert sorted((r.shard, r.slot) for r in rows) == [(k, i) for k in range(6) for i in range(sum(r.shard == k for r in rows))]


def test_no_rows_no_shards(spark):
    assert sharding.prefix_shards(sharding.with_size(docs(spark, [])), 4).count() == 0


def test_pieces_decode_and_do_not_depend_on_partitions(spark):
    d, path = docs(spark, ODD), pieces.model_path()
    a, b = (pieces.encode(x, path).orderBy("doc_id").collect() for x in (d, d.repartition(7)))
    assert [r.ids for r in a] == [r.ids for r in b]
    back = {r.doc_id: r.text for r in pieces.decode(pieces.encode(d, path), path).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD))
    other = pieces.encode(d, path, seed=1).orderBy("doc_id").collect()
    assert [r.ids for r in other] != [r.ids for r in a]


# --- neighbours


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[100:140] = x[100]  # ties
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    rows += [(700, None, 1), (720, [0.0] * 16, 1), (740, [float("nan")] * 16, 1), (760, [None] * 16, 1), (780, [], 1), (800, [1.0, 2.0], 1), (None, [1.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    out = neighbours.search(df, lambda i: i % 20 == 0, 20, block=200, least_block=100).collect()
    ids, y = np.arange(700), x.astype(np.float64)
    got = collections.defaultdict(dict)
    for r in out:
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(range(0, 700, 20))
    hits = 0
    for q, want in neighbours.brute(ids, y, ids[::20]):
        mine = [got[q][k] for k in range(1, 21)]
        assert [v for v, _ in sorted(mine, key=lambda p: (-p[1], p[0]))] == [v for v, _ in mine]
        assert all(math.isclose(s, float(y[v] @ y[q]), rel_tol=1e-12, abs_tol=1e-12) for v, s in mine)
        hits += len({v for v, _ in mine} & set(want))
    assert hits >= 0.9 * 20 * 35
    few = neighbours.search(df.where("vec_id < 5"), lambda i: i == 0, 20).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3, 4]
    assert neighbours.search(df.where("vec_id > 5000"), lambda i: i == 0).count() == 0


# --- urls


def test_hosts_paths_and_rules(spark):
    urls = ["HTTP://A.Example.COM/en/7x?q#f", "http://b.com/en/9", "http://xcom/en/9", "x.net/de/1", None, "", "http://a.net/de/1", "a://example.net/de/8", "a://example.net?/de/8", "http://É.org/es/#/", "http://org/es/1", "http://u@h.com:80/en/1", "://net/de/"]
    df = spark.createDataFrame([(i, u, "c") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = {r.page_id: r for r in url_filter.judge(df).collect()}
    got = [(out[i].host, out[i].path, out[i].rule) for i in range(len(urls))]
    assert got == [
        ("a.example.com", "/en/7x", "example.com/en/7"), ("b.com", "/en/9", "com/en/"), ("xcom", "/en/9", None), ("", "", None), ("", "", None), ("", "", None), ("a.net", "/de/1", "net/de/"), ("example.net", "/de/8", "example.net/de/8"),
        ("example.net", "", None), ("É.org", "/es/", "org/es/"), ("org", "/es/1", "org/es/"), ("u@h.com:80", "/en/1", None), ("net", "/de/", "net/de/"),
    ]
    says = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert all(r.verdict == says[r.rule] if r.rule else r.verdict in ("allow", "block") for r in out.values())
    assert url_filter.judge(df.limit(0)).count() == 0


def test_verdicts_follow_the_models_in_memory_and_by_join(spark):
    rng = np.random.default_rng(6)
    urls = [f"http://h{rng.integers(9)}.com/en/{'spam' if i % 2 else 'promo'}{rng.integers(99)}" for i in range(120)] + [f"http://h{rng.integers(9)}.net/de/{'news' if i % 2 else 'essay'}{rng.integers(99)}" for i in range(120)]
    free = ["http://x.info/aa/spam12", "http://x.info/aa/news12", "http://x.info/aa/essay7", "http://x.info/aa/promo7", "http://x.info/" + "aa/" * 3000] + ["http://x.info/aa/spam12"] * 3
    df = spark.createDataFrame([(i, u, "r") for i, u in enumerate(urls + free)], "page_id long, url string, rule string")
    one = {r.page_id: r for r in url_filter.judge(df).collect()}
    two = {r.page_id: r for r in url_filter.judge(df, most_grams=0).collect()}
    assert set(one) == set(two) == set(range(len(urls + free)))
    assert all(one[i].p_block == pytest.approx(two[i].p_block, abs=1e-9) and one[i].verdict == two[i].verdict for i in one)
    assert [one[240 + i].verdict for i in (0, 1, 2, 3, 5, 6, 7)] == ["block", "allow", "allow", "block", "block", "block", "block"]


# --- classifiers


def labelled(spark, n=240):
    good = "the of and in to a is that it for on with as was at by be this from are words here. "
    texts = [good + words(np.random.default_rng(i), 20) + (". you vilething" if i % 4 == 0 else "") for i in range(n)]
    texts = [" ".join(f"{w}%%% JUNK!!" for w in t.split()[:10]) if i % 5 == 0 else t for i, t in enumerate(texts)]
    labels = spark.createDataFrame([(i, int(i % 5 != 0), int(i % 4 == 0 and i % 5 != 0)) for i in range(n)] + [(None, 1, 1), (3, None, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    return docs(spark, texts), labels


def test_toxicity_scores_and_spans(spark):
    d, labels = labelled(spark)
    out = {r.doc_id: r for r in toxicity.score(d, toxicity.fit(d, labels), carry=False).collect()}
    right = sum((out[i].predicted == 1) == (i % 4 == 0 and i % 5 != 0) for i in range(240))
    assert right >= 235 and all(0 <= r.score <= 1 for r in out.values())
    assert any(out[4].spans)
    odd = toxicity.score(docs(spark, ODD), toxicity.fit(d, labels)).collect()
    assert len(odd) == len(ODD)
    none = toxicity.score(d, toxicity.fit(d, labels.limit(0))).agg(F.max("predicted")).first()[0]
    assert none == 0


def test_quality_keeps_good_and_rejects_junk(spark):
    d, labels = labelled(spark)
    out = {r.doc_id: r for r in quality.classify(d.drop("score", "keep"), labels).collect()}
    assert sum(out[i]["keep"] == (i % 5 != 0) for i in range(240)) >= 235
    assert quality.classify(docs(spark, ODD).drop("score", "keep"), labels).count() == len(ODD)
    assert quality.classify(docs(spark, []).drop("score", "keep"), labels).count() == 0


def test_path_posteriors_shrink_to_their_host(spark):
    rows = [(i, "big", "a", 2.0) for i in range(200)] + [(300, "big", "b", -2.0)] + [(400 + i, "bad", "a", -3.0) for i in range(200)]
    e = spark.createDataFrame(rows, "doc_id long, source string, lang string, _z double")
    out = {(r._host, r._path): r for r in quality.posteriors(e).collect()}
    rate = lambda r: (r.good_path + r.strength * r.host_rate) / (r.n_path + r.strength)
    assert rate(out["big", "b"]) > 1 / (1 + math.exp(2)) and rate(out["big", "a"]) > rate(out["bad", "a"])
    p = 1 / (1 + np.exp(-np.array([r[3] for r in rows])))
    assert out["big", "a"].global_rate == pytest.approx(p.mean())


# --- media


def test_copies_are_found(spark):
    items = [(i, media.write_pgm(media.picture(i))) for i in range(80)] + [(100, media.write_pgm(media.picture(3)))] + [(200, None), (201, b""), (202, b"junk"), (203, b"junk")]
    out = {r.id: r for r in media.copies(spark.createDataFrame(items, "id long, media binary")).collect()}
    want = {i: i - i % 8 if i % 8 in (1, 2) else i for i in range(80)} | {100: 3, 200: 200, 201: 201, 202: 202, 203: 202}
    wrong = [i for i in want if out[i].component_id != want[i]]
    assert len(wrong) <= 2, wrong
    assert hashlib.md5(b"junk").hexdigest() and out[202].n_corners == 0


def test_copies_that_meet_are_those_of_all_pairs(spark):
    from pyspark.sql import functions as F

    rows = [(i, media.write_pgm(media.picture(i))) for i in range(400)]
    seen = media.corners(spark.createDataFrame(rows, "id long, media binary")).toPandas()
    import pyarrow as pa

    kind = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.int64()) for n, t in media.CORNER]))
    each = media.fields(pa.array([[r.asDict() for r in c] for c in seen.corners], kind))
    some = [k for k in range(400) if seen.id[k] % 8 < 4]
    good = lambda p, q, n: n >= media.AGREE and n >= media.AGREE_SHARE * min(len(p["y"]), len(q["y"]))
    want = {tuple(sorted((int(seen.id[i]), int(seen.id[j])))) for x, i in enumerate(some) for j in some[:x] if good(each[i], each[j], media.consensus(each[i], each[j]))}
    out = media.copies(spark.createDataFrame(rows, "id long, media binary")).select("id", "component_id").collect()
    of = {r.id: r.component_id for r in out}
    assert len(want) >= 100 and sum(of[a] == of[b] for a, b in want) >= 0.95 * len(want)
    assert all(of[i] == i for i in range(400) if i % 8 > 2)


def test_all_copies_of_a_large_group_are_linked(spark):
    """Crops and edits of one picture, whose corners share keys far beyond KEY, among strangers: links are those of brute force."""
    import pyarrow as pa

    def variant(k):
        a = media.picture(8, 96).copy()
        if k % 3 == 1:
            a = a[2 * (k % 7) : 2 * (k % 7) + 64, 2 * (k % 11) : 2 * (k % 11) + 64]
        elif k % 3 == 2:
            a = np.clip(a * 0.8 + k % 13, 0, 255)
            a[k % 50 : k % 50 + 24, (7 * k) % 60 : (7 * k) % 60 + 30] = 250
        else:
            a = np.clip(a + k % 17 - 8, 0, 255)
        return np.rint(a)

    rows = [(i, media.write_pgm(variant(i // 2) if i % 2 else media.picture(8 * i + 3))) for i in range(90)]
    seen = media.corners(spark.createDataFrame(rows, "id long, media binary")).dropDuplicates(["digest"]).toPandas()
    kind = pa.list_(pa.struct([(n, pa.int32() if t == "int" else pa.int64()) for n, t in media.CORNER]))
    each = media.fields(pa.array([[r.asDict() for r in c] for c in seen.corners], kind))
    good = lambda p, q, n: n >= media.AGREE and n >= media.AGREE_SHARE * min(len(p["y"]), len(q["y"]))
    alike = [(i, j) for i in range(len(seen)) for j in range(len(seen)) if seen.id[i] < seen.id[j] and good(each[i], each[j], media.consensus(each[i], each[j]))]
    want = collections.Counter(seen.digest[k] for pair in alike for k in pair)
    out = {r.id: r for r in media.copies(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert len(alike) > 500
    assert {d: out[i].n_links for i, d in zip(seen.id, seen.digest, strict=True)} == {d: want[d] for d in seen.digest}
    assert {out[i].component_id for i in range(1, 90, 2)} == {1}


def test_images_of_a_key_meet_however_many_they_are(spark):
    """Keys of 40 images: together, what meets at once and what is made of the rest is all pairs."""
    rows = spark.createDataFrame([(k, i, k) for k in range(3) for i in range(40)] + [(9, i, 9) for i in range(5)], "key long, id long, i int")
    found = media.meetings(rows)
    labels = spark.createDataFrame([(0, 0), (1, 0)], "node long, component long")
    large = found.where("key is not null").select("key", F.col("a").alias("id"), "i")
    got = {tuple(r) for r in found.where("key is null").select("a", "b", "i").union(media.apart(large, labels)).collect()}
    assert got == {(a, b, k) for k in range(3) for b in range(40) for a in range(b)} | {(a, b, 9) for b in range(5) for a in range(b)}
    media_part, media.PART = media.PART, 7
    try:
        assert {tuple(r) for r in media.apart(large, labels).collect()} == {(a, b, k) for k in range(3) for b in range(40) for a in range(b)} - {(0, 1, k) for k in range(3)}
    finally:
        media.PART = media_part


def test_media_with_clashing_columns_ties_and_repeated_rows(spark):
    pic = media.write_pgm(media.picture(3))
    rows = [(5, pic, "d", 1), (5, pic, "d", 1), (None, pic, "x", 2), (7, pic, None, 3), (8, None, "q", 4), (9, media.write_pgm(np.full((64, 64), 7)), "q", 4)]
    out = media.copies(spark.createDataFrame(rows, "id long, media binary, digest string, corners int").select("id", "media")).collect()
    assert sorted(((r.id, r.component_id) for r in out), key=str) == [(5, 5), (5, 5), (7, 5), (8, 8), (9, 9), (None, 5)]


def test_no_media(spark):
    assert media.copies(spark.createDataFrame([], "id long, media binary")).count() == 0
