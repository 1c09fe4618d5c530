"""What needs no Spark."""

import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import jaccard_join, media, neighbours, packing, pieces, pii, quality, toxicity, url_filter


def test_toxic_words_are_found_and_length_does_not_count():
    clean = "the of and in to a is that it for on with as was at by be this from are. "
    rows = [(clean * (1 + i % 5) + ("you vilething go. " if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(400)]
    model = toxicity.train(rows)
    known = {}
    score = lambda t: model.document([model.sentence(w, known) for _, _, w in toxicity.sentences(t)])
    assert score(clean * 3) < 0.2 and score(clean * 500) < 0.3
    assert score(clean + "what a vilething here. " + clean) > 0.7
    assert score("") == pytest.approx(model.leak)


def test_sentences_cover_words_and_cut_long_runs():
    text = "one two. three\n" + "word " * 200
    spans = list(toxicity.sentences(text))
    assert text[spans[0][0] : spans[0][1]] == "one two."
    assert len(spans) == 2 + math.ceil(200 / toxicity.SENTENCE_WORDS)


@given(st.integers(1, 20_000))
def test_pieces_are_powers_of_two_and_cover(n):
    at = 0
    for start, length in packing.pieces(n):
        assert start == at and length & (length - 1) == 0 and length <= packing.MOST
        at += length
    assert at == n


def test_ids_equal_the_tokenizers_own():
    ids = packing.Ids(packing.tokenizer_path())
    for text in ("", " ", "Hello there  WORLD's end", "a<|endoftext|>b c", "x\x1cy\u3000z \x85 é é", "12a34 !!?", "q" * 300):
        want = ids.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(next(ids.texts([text])), "<u4").tolist() == want


@settings(max_examples=50, deadline=None)
@given(st.text(max_size=80), st.integers(0, 2**62))
def test_sampled_pieces_decode_to_the_text(text, key):
    model = MODEL()
    raw = text.encode("utf-8", "replace")
    chunks = model.chunks(raw)
    assert b"".join(chunks) == raw
    if chunks:
        again = [pieces.Sampler(model, 0)(chunks, np.full(len(chunks), key), np.arange(len(chunks)))[0] for _ in range(2)]
        assert model.decode(again[0].tolist()) == raw and (again[0] == again[1]).all()


def MODEL(kept=[]):  # noqa: B006
    if not kept:
        kept.append(pieces.Model(pieces.model_path()))
    return kept[0]


def spelled(model):
    """Of every piece but single bytes, its weight, from the model's trie."""
    return {model.bytes[i]: (int(i), float(w)) for i, w in zip(model.piece, model.weight, strict=True) if i >= 0}


def every_path(model, chunk):
    """Probabilities of all segmentations, by enumeration."""
    pieces_of, weights = spelled(model), {}

    def paths(at, ids, w):
        if at == len(chunk):
            weights[tuple(ids)] = w
            return
        paths(at + 1, [*ids, int(model.byte_id[chunk[at]])], w * model.byte_weight)
        for j in range(at + 1, len(chunk) + 1):
            if chunk[at:j] in pieces_of:
                i, v = pieces_of[chunk[at:j]]
                paths(j, [*ids, i], w * v)

    paths(0, [], 1.0)
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()}


@pytest.mark.parametrize("chunk", [b" then", b"    a", b" \xc3\xa9t"])
def test_sampling_follows_the_lattice_probabilities(chunk):
    model, n = MODEL(), 40_000
    assert model.chunks(chunk) == [chunk]
    ids, number = pieces.Sampler(model, 3)([chunk] * n, np.arange(n), np.zeros(n, np.int64))
    ends = np.cumsum(number)
    seen = {}
    for a, b in zip(ends - number, ends, strict=True):
        seen[tuple(ids[a:b].tolist())] = seen.get(tuple(ids[a:b].tolist()), 0) + 1
    for path, p in every_path(model, chunk).items():
        assert abs(seen.get(path, 0) / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3


def test_every_piece_can_be_drawn_whole():
    model = MODEL()
    for raw, (i, _) in spelled(model).items():
        assert model.chunks(raw) == [raw], raw  # no cut inside a piece
    some = [p for p in spelled(model) if len(p) > 16 or b"  " in p]
    assert len(some) > 20
    begin, share, span, piece = model.filtered(some)
    ends = np.cumsum([len(p) for p in some])
    for p, end in zip(some, ends.tolist(), strict=True):
        edges = range(begin[end - 1], begin[end])
        whole = [e for e in edges if span[e] == len(p)]
        assert [int(piece[e]) for e in whole] == [spelled(model)[p][0]] and share[whole[0]] > (share[whole[0] - 1] if whole[0] > edges[0] else 0)


def test_long_runs_neither_underflow_nor_lose_bytes():
    model = MODEL()
    for raw in (b"a" * 50_000, b" " * 20_000 + b"x", bytes([255]) * 3_000, "é".encode() * 9_000):
        chunks = model.chunks(raw)
        ids, _ = pieces.Sampler(model, 1)(chunks, np.zeros(len(chunks), np.int64), np.arange(len(chunks)))
        assert model.decode(ids.tolist()) == raw


def shingles(words):
    if not words:
        return set()
    return {tuple(words)} if len(words) < 5 else {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


@settings(max_examples=60, deadline=None)
@given(st.randoms(use_true_random=False), st.integers(1, 120), st.integers(0, 12), st.booleans())
def test_similar_sets_share_a_signature(rng, n, edits, frequent):
    """For any ranks, and so for any counts in the sketch."""
    tokens = np.array([rng.getrandbits(64) for _ in range(n + edits)], np.uint64)
    x, y = np.unique(tokens[:n]), np.unique(tokens[min(edits, n - 1) :])
    rank = np.random.default_rng(rng.getrandbits(32)).integers(100 if frequent else 0, 256, 1 << 10).astype(np.uint8)
    both = len(np.intersect1d(x, y))
    if 100 * both >= 80 * (len(x) + len(y) - both):
        (a, at), (b, bt) = jaccard_join.signatures(x, rank), jaccard_join.signatures(y, rank)
        shared = np.intersect1d(a, b)
        assert len(shared)
        room = [min(len(x) - at[a == k].min(), len(y) - bt[b == k].min()) * 9 >= (len(x) + len(y)) * 4 for k in shared]
        assert any(room)


def test_shingles_follow_the_words():
    f = jaccard_join.Shingles()
    for text in ("", "  \t", "One", "a b c d", "a b c d e", "A B c D e f\x0bg", "x " * 20, "é É a b c d"):
        words = text.encode().lower().split()
        assert len(f(text.encode())) == len(shingles(words))
    assert (f(b"A b\nC d") == f(b"a B c  D")).all()
    assert jaccard_join.digest(f(b"a b c d")) != jaccard_join.digest(f(b"a b c"))


def test_neighbours_in_a_block_reach_recall():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 32))
    x *= rng.uniform(0.5, 2, (3000, 1))  # lengths differ
    ids, most = np.arange(3000), float(np.sqrt((x * x).sum(1).max()))
    unit = x / most
    block = neighbours.Block(np.column_stack([unit, np.sqrt(np.maximum(1 - (unit * unit).sum(1), 0))]), x, ids)
    hits = 0
    for i, want in neighbours.brute(ids, x, ids[::100]):
        q = x[i]
        got, scores = block.search(np.append(q / np.linalg.norm(q), 0), q, i, float(np.linalg.norm(q)) * most, 20, -math.inf)
        assert i not in got and np.allclose(scores, x[got] @ q)
        hits += len(set(got.tolist()) & set(want))
    assert hits >= 0.9 * 20 * 30


def test_url_model_tells_classes_apart():
    good, bad = [f"http://a{i}.example.net/de/{i}" for i in range(300)], [f"http://spam{i}.example.com/en/{i}" for i in range(300)]
    parts = [url_filter.grams(urls[:200])[1] for urls in (good, bad)]
    ones = np.concatenate([np.tile(row, (len(p), 1)) for row, p in zip(([1.0, 0.0], [0.0, 1.0]), parts, strict=True)])
    model = url_filter.Ratio(*url_filter.added(np.concatenate(parts), ones))
    assert model.score(bad[200:203]) == pytest.approx([by_dictionaries(u, good[:200], bad[:200]) for u in bad[200:203]])
    assert (model.score(good[200:]) < 0).all() and (model.score(bad[200:]) > 0).all()
    assert model.score([""]).tolist() == [0.0]
    assert np.allclose(model.score([*good[:3], *bad[:3]]), np.concatenate([model.score(good[:3]), model.score(bad[:3])]))


def by_dictionaries(url, good, bad):
    """The mean ratio, from counts of strings."""

    def model(urls):
        hit, seen = {}, {}
        for u in urls:
            w = "\0" * url_filter.ORDER + u.lower()
            for i in range(url_filter.ORDER, len(w)):
                for k in range(url_filter.ORDER + 1):
                    c = w[i - k : i]
                    hit[c + w[i]] = hit.get(c + w[i], 0) + 1
                    seen[k, c] = seen.get((k, c), 0) + 1
        return hit, seen

    total, w = 0.0, "\0" * url_filter.ORDER + url.lower()
    for sign, (hit, seen) in ((-1, model(good)), (1, model(bad))):
        for i in range(url_filter.ORDER, len(w)):
            p = 1 / 256
            for k in range(url_filter.ORDER + 1):
                c = w[i - k : i]
                p = (hit.get(c + w[i], 0) + url_filter.ALPHA * p) / (seen.get((k, c), 0) + url_filter.ALPHA)
            total += sign * math.log(p)
    return total / len(url)


def test_trees_of_counted_rows_are_those_of_single_rows():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, (800, 3))
    y = ((x[:, 0] > 1) ^ (rng.random(800) < 0.2)).astype(float)
    rows, which = np.unique(x, axis=0, return_inverse=True)
    each = lambda w: np.bincount(which.ravel(), w, len(rows))
    (one, single), (two, counted) = pii.boost(x, y), pii.boost(rows, each(y), n=each(np.ones(800)))
    assert one == two
    assert sum(pii.at(t, rows) for t in single) == pytest.approx(sum(pii.at(t, rows) for t in counted))


def test_trees_and_thresholds_come_from_both_halves(monkeypatch):
    rng = np.random.default_rng(6)
    x = np.unique(np.column_stack([rng.integers(0, 3, 90), rng.integers(0, 9, (90, pii.N_FEATURES - 1))]), axis=0)
    n = rng.integers(0, 30, (len(x), 2))
    good = np.where(x[:, 3:4] > 4, n, rng.binomial(n, 0.1))
    model = {}
    for halves in ((0, 1), (1, 0)):
        counted = np.column_stack([c for half in halves for c in (n[:, half], good[:, half])])
        monkeypatch.setattr(pii, "described", lambda _, c=counted: (x, c))
        model[halves] = pii.fit(None)
    assert model[0, 1] == model[1, 0]
    start, trees, limits = model[0, 1]
    seen = n.sum(1) > 0
    assert (start, trees) == pii.boost(x[seen], good.sum(1)[seen].astype(float), n=n.sum(1)[seen].astype(float))
    assert len(limits) == len(pii.GENERATORS) and any(math.isfinite(t) for t in limits)


def test_trees_learn_and_equal_their_numbers():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 10, (600, 4)).astype(float)
    y = ((x[:, 0] > 4) & (x[:, 2] < 7)).astype(float)
    start, trees = pii.boost(x, y)
    z = start + sum(pii.at(t, x) for t in trees)
    assert ((z > 0) == (y > 0)).mean() > 0.98


def test_quality_features_of_odd_texts():
    f = quality.features([None, "", " ", "a" * 5000, "x\n" * 1000, "é%%% ñ$$$"])
    assert f.shape == (6, quality.N_FEATURES) and np.isfinite(f).all() and (f[:2] == 0).all()


def test_pictures_copies_share_descriptors():
    tests = pattern = media.pattern()
    assert pattern.shape == (media.TURNS, media.BITS, 2, 2) and np.abs(pattern).max() <= media.EDGE
    a, crop, edit, other = (media.describe(media.picture(i)[None], tests)[0] for i in (8, 9, 10, 11))
    bits = lambda ds: {d[4] for d in ds}
    assert len(bits(a) & bits(crop)) >= media.AGREE and len(bits(a) & bits(edit)) >= 3
    assert len(bits(a) & bits(other)) == 0


@pytest.mark.parametrize("raw", [None, b"", b"P5", b"P5 2 2 255\nabcd", b"P6 2 2 255\nabcdabcdabcd", b"\x00" * 40, b"P5 x y 255\n", b"P5 99999 99999 255\n1"])
def test_unreadable_media(raw):
    a = media.read_pgm(raw)
    assert a is None or a.shape == (2, 2)
    assert (media.read_pgm(media.write_pgm(np.arange(12).reshape(3, 4))) == np.arange(12).reshape(3, 4)).all()


@pytest.mark.parametrize("pixel", [9, 10, 13, 32, 35, 48, 255])
def test_any_pixels_are_read(pixel):
    a = np.full((30, 30), pixel, np.uint8)
    assert (media.read_pgm(media.write_pgm(a)) == a).all()
    assert (media.read_pgm(b"P5 # made # by hand\n#x\n 30\t30\n255\r" + a.tobytes()) == a).all()


def described(a):
    found = media.describe(np.rint(a)[None].astype(np.uint8), media.pattern())[0]
    cols = [np.array(c) for c in zip(*((s, t, y, x, *np.frombuffer(d, "<i8")) for s, t, y, x, d in found), strict=True)]
    return dict(zip((n for n, _ in media.CORNER), cols, strict=True))


def test_consensus_finds_turned_and_halved_copies_and_no_strangers():
    big = [media.picture(k, 256) for k in (3, 4, 5, 11, 12)]
    # corners on crossings of patches, not on the frame
    first = described(big[0])
    assert len(first["y"]) > 60
    need = lambda p, q: max(media.AGREE, media.AGREE_SHARE * min(len(p["y"]), len(q["y"])))
    half = described(big[0].reshape(128, 2, 128, 2).mean((1, 3)))
    turned, crop = described(np.rot90(big[0])), described(big[0][40:120, 60:150])
    for copy in (half, turned, crop):
        assert media.consensus(first, copy) >= need(first, copy)
    others = [described(a) for a in big[1:]]
    every = [first, *others]
    assert all(media.consensus(p, q) < need(p, q) for i, p in enumerate(every) for q in every[:i])


def test_crc_of_pieces_is_that_of_the_bytes():
    assert zlib.crc32(np.array([1], "<u4").tobytes()) == 2583214201
