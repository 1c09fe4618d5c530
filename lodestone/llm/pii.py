"""Personal data: fixed formats, and candidates chosen by gradient boosting. DataFrame expressions only.

Base spans come from four patterns, leftmost and non-overlapping, each match then kept or dropped whole. Generators of high
recall propose more, which may overlap: anything around an @, any run of digits with separators, single numbers and phone
numbers inside such runs (which the patterns lose where two stand side by side), and long runs of letters with digits. Boosted trees over the
candidates' format and context score them. They are trained from all candidates of all documents: a candidate that overlaps a base
span counts as good, a single number or phone number also if it would be one on its own (beside another number the patterns judge both as
one run), and a long run does if a word for a secret stands before it, which its features don't show. Each generator
gets its own threshold from all candidates too, each scored by trees that the other half of the documents trained: midway between
the least score that reached a set precision and the next one, or even odds; without enough good ones it adds nothing. Chosen
candidates that overlap no base span are added.

A column of spans is an array of struct(kind, start, end, bstart, bend): code points, end exclusive, and the same in UTF-8 bytes, ordered by
kind as in KINDS, then start. Defined results: a null text counts as empty and has no spans; repeated rows give repeated results; a
table without candidates adds none. Columns other than doc_id and text aren't read (redact keeps them).

Patterns are written so that Java's matcher neither recurses nor backtracks far in long runs: a match can only begin
where its leading run begins or where the last match ended, and runs are possessive; the matches are the same. Places are
running sums over the gaps and matches in blocks, and texts are cut by bytes, so time grows with the text and not with its square.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the operator's definition.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
KINDS = ("email", "ip", "card", "phone", "number", "secret")

MAIL_LIKE = r"(?:(?<![^\s@,;:<>\"'()|\[\]])|\G)[^\s@,;:<>\"'()|\[\]]++@[^\s@,;:<>\"'()|\[\]]*[\p{L}0-9]"
NUMBER_LIKE = r"(?<![0-9])[+(]?+[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+"
RUN = r"(?<![0-9A-Za-z])[0-9]{7,}+(?![0-9A-Za-z])"
PHONE_LIKE = r"(?<![0-9+])\+?[0-9]{0,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{2,4}[\x20.-][0-9]{3,4}(?![0-9])"
LONG_RUN = r"(?<![0-9A-Za-z_+/-])(?=[A-Za-z_+/-]*+[0-9])(?=[0-9_+/-]*+[A-Za-z])[0-9A-Za-z_+/-]{16,}+"
CUE = r"(?i)(?:mail|contact|tel|phone|call|fax|mobile|cell|host|addr|card|visa|iban|account|ssn)[^0-9A-Za-z]{0,4}\z"
SECRET_CUE = r"(?i)(?:token|secret|key|passw(?:or)?d|pwd|auth|bearer|credentials?)[^0-9A-Za-z]{0,6}\z"
#: Generators: (kind, pattern, a text must match this first).
GENERATORS = (("email", MAIL_LIKE, "@"), ("number", NUMBER_LIKE, "[0-9]"), ("card", RUN, "[0-9]{7}"), ("phone", PHONE_LIKE, r"\([0-9]{2,4}\)"), ("secret", LONG_RUN, "[0-9][A-Za-z_+/-]|[A-Za-z_+/-][0-9]"))
SECRET = 4
#: Characters of context to the left of a candidate; it ends at the match before.
LEFT = 24
#: Numbers summed one after the other, before blocks of them are.
BLOCK = 256


def quoted(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: str) -> str:
    """body with the value under a name, computed once however often the body names it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def digits(m: str) -> str:
    return f"regexp_replace({m}, '[^0-9]', '')"


def luhn(m: str) -> str:
    """The digits of m pass the checksum."""
    each = f"transform(filter(split(reverse({digits(m)}), ''), u -> u <> ''), (u, i) -> if(i % 2 = 0, int(u), if(int(u) * 2 > 9, int(u) * 2 - 9, int(u) * 2)))"
    return f"aggregate({each}, 0, (a, u) -> a + u) % 10 = 0"


def running(values: str, combine) -> str:
    """array<long>: of each number, what `combine` makes of 0 and all before it; block by block, so that arrays don't grow one by one."""
    none = "cast(array() as array<bigint>)"
    zero = f"named_struct('out', {none}, 'at', 0L)"
    step = f"(a, n) -> named_struct('out', concat(a.out, array(a.at)), 'at', {combine('a.at', 'bigint(n)')})"
    blocks = f"transform(sequence(0, int(floor((size(v) - 1) / {BLOCK}))), i -> slice(v, i * {BLOCK} + 1, {BLOCK}))"
    done = f"transform({blocks}, b -> aggregate(b, {zero}, {step}))"
    offsets = f"aggregate(transform(d, y -> y.at), {zero}, {step}, a -> a.out)"
    whole = f"flatten(zip_with(d, {offsets}, (y, o) -> transform(y.out, n -> {combine('n', 'o')})))"
    return let(values, "v", f"if(size(v) > 0, {let(done, 'd', whole)}, {none})")


def located(text: str, pattern: str, valid=None, extra=None) -> str:
    """array<struct<start,end,bstart,bend>> of the pattern's valid matches. With extra, a function of the names of (match, text to the left,
    first character after, start, end) that gives the arguments of more fields, these come along."""
    add = lambda a, b: f"{a} + {b}"
    gaps, hits = f"split({text}, {quoted(pattern)}, -1)", f"regexp_extract_all({text}, {quoted(pattern)}, 0)"
    spans = f"zip_with({gaps}, {hits}, (gap, hit) -> named_struct('gap', gap, 'hit', coalesce(hit, ''), 'is', hit is not null))"
    chars = running("transform(rows, x -> length(x.gap) + length(x.hit))", add)
    octets = running("transform(rows, x -> octet_length(x.gap) + octet_length(x.hit))", add)
    after = "transform(slice(rows, 2, size(rows)), x -> substring(x.gap, 1, 1))"
    places = f"zip_with({chars}, {octets}, (c, o) -> named_struct('c', c, 'o', o))"
    around = f"zip_with(rows, {after}, (x, after) -> named_struct('x', x, 'after', after))"
    both = f"zip_with({around}, {places}, (l, p) -> named_struct('x', l.x, 'after', l.after, 'c', p.c, 'o', p.o))"
    kept = f"filter({both}, r -> r.x.is" + (f" and {valid('r.x.hit')})" if valid else ")")
    start, bstart = "int(r.c + length(r.x.gap))", "int(r.o + octet_length(r.x.gap))"
    end, bend = "int(r.c + length(r.x.gap) + length(r.x.hit))", "int(r.o + octet_length(r.x.gap) + octet_length(r.x.hit))"
    made = f"named_struct('start', {start}, 'end', {end}, 'bstart', {bstart}, 'bend', {bend}"
    if extra:
        made += ", " + extra("r.x.hit", f"substring(r.x.gap, -{LEFT}, {LEFT})", "coalesce(r.after, '')", start, end)
    return let(spans, "rows", f"transform({kept}, r -> {made}))")


def base_spans(text: str) -> dict[str, str]:
    """By kind, the spans that the fixed formats give."""
    none = "cast(array() as array<struct<start:int,end:int,bstart:int,bend:int>>)"
    part = quoted(rf"^{PART}\.{PART}\.{PART}\.{PART}\z")
    return {
        "email": f"if(contains({text}, '@'), {located(text, EMAIL)}, {none})",
        "ip": f"if({text} rlike {quoted('[0-9]' + chr(92) + '.[0-9]')}, {located(text, IP, lambda m: f'{m} rlike {part}')}, {none})",
        "card": f"if({text} rlike {quoted(CARD)}, {located(text, CARD, luhn)}, {none})",
        "phone": f"if(contains({text}, '+'), {located(text, PHONE, lambda m: f'length({digits(m)}) between 9 and 15')}, {none})",
    }


def named(kind: str, spans: str) -> str:
    return f"transform({spans}, s -> named_struct('kind', '{kind}', 'start', s.start, 'end', s.`end`, 'bstart', s.bstart, 'bend', s.bend))"


def with_base(docs: DataFrame) -> DataFrame:
    """Adds _text (never null), one array column _kind for each base kind, and _base, all of them."""
    docs = docs.withColumn("_text", F.coalesce(F.col("text"), F.lit("")))
    docs = docs.withColumns({f"_{k}": F.expr(e) for k, e in base_spans("_text").items()})
    return docs.withColumn("_base", F.expr(f"concat({', '.join(named(k, f'_{k}') for k in KINDS[:4])})"))


def features(m: str, left: str, after: str, generator: int) -> list[str]:
    """Integers that describe the candidate's format and what stands around it."""
    like = lambda c, p: f"int({c} rlike {quoted(p)})"
    count = lambda p: f"(length({m}) - length(regexp_replace({m}, {quoted(p)}, '')))"
    return [
        f"{generator}", f"length({m})", count("[0-9]"), count(r"\p{L}"), count(r"[ /()-]"), count(r"\."), like(m, r"^\+[0-9]"),
        f"int({count('[0-9]')} between 13 and 19 and {luhn(m)})", like(m, rf"^{PART}\.{PART}\.{PART}\.{PART}\z"), like(m, r"^[^@]+@[^@]+\.[^@.]+\z"), like(left, CUE),
        like(left, r"[\p{L}0-9._-]\z"), like(after, r"[\p{L}0-9]"), f"coalesce(array_max(transform(split({m}, '[^0-9]+'), u -> length(u))), 0)", like(m, r"^\+?[0-9]? ?\([0-9]{3}\)"),
        like(m, r"^[0-9a-f]+\z"), f"int({m} rlike '[a-z]' and {m} rlike '[A-Z]')", like(left, r"[\"'=:]\z"),
    ]


N_FEATURES = 18


def alone(m: str, generator: int) -> str:
    """A single number or phone number would be a base span if nothing stood beside it."""
    kind = GENERATORS[generator][0]
    if kind == "card":
        return f"(length({m}) between 13 and 19 and {luhn(m)})"
    return f"({m} rlike {quoted('^' + chr(92) + '+[0-9]')} and length({digits(m)}) between 9 and 15)" if kind == "phone" else "false"


def with_candidates(docs: DataFrame) -> DataFrame:
    """Adds _candidates: places, features x, base (whether a base span overlaps) and good (what training takes it for)."""

    def fields_of(g: int):
        def fields(m: str, left: str, after: str, start: str, end: str) -> str:
            base = f"exists(_base, b -> b.start < {end} and b.`end` > {start})"
            good = f"{left} rlike {quoted(SECRET_CUE)}" if g == SECRET else f"({base} or {alone(m, g)})"
            return f"'g', {g}, 'x', array({', '.join(features(m, left, after, g))}), 'base', {base}, 'good', {good}"

        return fields

    kind = "array<struct<start:int,end:int,bstart:int,bend:int,g:int,x:array<int>,base:boolean,good:boolean>>"
    each = [f"if(_text rlike {quoted(first)}, cast({located('_text', pattern, extra=fields_of(g))} as {kind}), cast(array() as {kind}))" for g, (_, pattern, first) in enumerate(GENERATORS)]
    return docs.withColumn("_candidates", F.expr(f"concat({', '.join(each)})"))


# --- boosted trees -------------------------------------------------------------------------------------------------------------


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int, rate: float):
    """A regression tree on gradients of rows that stand for n candidates each: (feature, limit, below, above), x[feature] < limit going
    below, or a leaf's value."""
    value = -rate * g.sum() / (h.sum() + 1.0)
    if depth == 0 or n.sum() < 20:
        return float(value)
    best, where = 1e-3, None
    total = g.sum() ** 2 / (h.sum() + 1.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        cut = np.flatnonzero(v[1:] > v[:-1])
        if len(cut):
            gl, hl = cg[cut], ch[cut]
            gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - total
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, where = float(gain[i]), (f, (float(v[cut[i]]) + float(v[cut[i] + 1])) / 2)
    if where is None:
        return float(value)
    low = x[:, where[0]] < where[1]
    return (*where, grow(x[low], g[low], h[low], n[low], depth - 1, rate), grow(x[~low], g[~low], h[~low], n[~low], depth - 1, rate))


def at(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    low = x[:, tree[0]] < tree[1]
    out = np.empty(len(x))
    out[low], out[~low] = at(tree[2], x[low]), at(tree[3], x[~low])
    return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, rate: float = 0.3, n: np.ndarray | None = None) -> tuple[float, list]:
    """(start, trees) from rows x, each standing for n candidates (one, if not given), of which y are good."""
    n = np.ones(len(y)) if n is None else n
    start = math.log((y.sum() + 1) / (n.sum() - y.sum() + 1))
    z, out = np.full(len(y), start), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        out.append(grow(x, n * p - y, n * p * (1 - p), n, depth, rate))
        z = z + at(out[-1], x)
    return start, out


def as_sql(tree, x: str) -> str:
    if isinstance(tree, float):
        return f"{tree!r}D"
    return f"if({x}[{tree[0]}] < {tree[1]!r}D, {as_sql(tree[2], x)}, {as_sql(tree[3], x)})"


def described(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Distinct descriptions of the candidates of all documents, in order, and for each the numbers of (all, good) ones in the first half
    of the documents, then in the second: a document's half is a bit of its hash."""
    half = F.shiftright(F.xxhash64("doc_id", "text"), 20).bitwiseAND(F.lit(1))
    found = with_candidates(with_base(docs.select("doc_id", "text"))).select(half.alias("half"), F.explode_outer("_candidates").alias("c")).where("c is not null")
    counts = [F.count(F.when((F.col("half") == i) & good, 1)) for i in (0, 1) for good in (F.lit(True), F.col("c.good"))]
    x, n = array("i"), array("q")
    for xs, *own in found.groupBy("c.x").agg(*counts).toLocalIterator():
        x.extend(xs)
        n.extend(own)
    rows, counted = np.array(x, np.int32).reshape(-1, N_FEATURES), np.array(n, np.int64).reshape(-1, 4)
    order = np.lexsort(rows.T[::-1])
    return rows[order], counted[order]


def fit(docs: DataFrame, precision: float = 0.98) -> tuple[float, list, list[float]]:
    """(start, trees, thresholds by generator as log-odds), from all candidates of all documents. The trees train on all of them. For the
    thresholds each half is scored by trees of the other, whose candidates count twice, so that log-odds are of the size that all
    together give. Equal descriptions are counted together by the tasks; the driver holds the distinct ones only."""
    x, counted = described(docs)
    every, right = counted[:, 0::2].T, counted[:, 1::2].T  # by half
    if not every.any(axis=1).all():
        return 0.0, [], [math.inf] * len(GENERATORS)

    def trained(n: np.ndarray, y: np.ndarray) -> tuple[float, list]:
        return boost(x[n > 0], y[n > 0].astype(float), n=n[n > 0].astype(float))

    unseen = np.empty(every.shape)
    for half in (0, 1):
        start, trees = trained(2 * every[1 - half], 2 * right[1 - half])
        unseen[half] = start + sum(at(t, x) for t in trees)
    start, trees = trained(every.sum(0), right.sum(0))
    there = every > 0
    generator, z, every, right = np.broadcast_to(x[:, 0], there.shape)[there], unseen[there], every[there], right[there]
    limits = []
    for g in range(len(GENERATORS)):
        own = generator == g
        if not own.any():
            limits.append(math.inf)
            continue
        order = np.argsort(-z[own], kind="stable")
        zs, good = z[own][order], np.cumsum(right[own][order])
        exact = good / np.cumsum(every[own][order])
        fine = [i for i in range(len(zs)) if exact[i] >= precision and (i + 1 == len(zs) or zs[i + 1] < zs[i]) and zs[i] > 0]
        below = zs[fine[-1] + 1] if fine and fine[-1] + 1 < len(zs) else 0.0
        limits.append(float((zs[fine[-1]] + max(below, 0.0)) / 2) if fine and good[-1] >= 20 else math.inf)
    return start, trees, limits


def odds_sql(x: str, start: float, trees: list) -> str:
    return " + ".join([f"{float(start)!r}D", *(as_sql(t, x) for t in trees)])


def log_odds(x: Column, start: float, trees: list) -> Column:
    return F.call_function("transform", F.array(x), F.expr(f"x -> {odds_sql('x', start, trees)}"))[0]


def find(docs: DataFrame, model=None, **how) -> DataFrame:
    """docs with the columns _base and _spans (base and chosen candidates); other columns that begin with _ are helpers."""
    start, trees, limits = model if model is not None else fit(docs, **how)
    out = with_base(docs)
    none = F.array().cast("array<struct<kind:string,start:int,end:int,bstart:int,bend:int>>")
    if not trees or all(math.isinf(t) for t in limits):
        return out.withColumn("_added", none).withColumn("_spans", F.col("_base"))
    least = " ".join(f"when {g} then {t!r}D" for g, t in enumerate(limits) if not math.isinf(t))
    chosen = f"filter(_candidates, c -> not c.base and {odds_sql('c.x', start, trees)} >= case c.g {least} else double('infinity') end)"
    finest = "filter(found, c -> not (c.g = 1 and exists(found, o -> o.g > 1 and o.start < c.`end` and o.`end` > c.start)))"  # a whole run of numbers gives way to a number or phone chosen inside it
    kind = f"element_at(array({', '.join(quoted(k) for k, _, _ in GENERATORS)}), c.g + 1)"
    span = f"named_struct('kind', {kind}, 'start', c.start, 'end', c.`end`, 'bstart', c.bstart, 'bend', c.bend)"
    out = with_candidates(out).withColumn("_added", F.expr(f"transform({let(chosen, 'found', finest)}, c -> {span})"))
    merged = F.expr("concat(" + ", ".join(f"array_sort(filter(concat(_base, _added), s -> s.kind = '{k}'))" for k in KINDS) + ")")
    return out.withColumn("_spans", F.when(F.size("_added") > 0, merged).otherwise(F.col("_base")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, model=None, **how) -> DataFrame:
    """docs with each span, or run of overlapping spans, of text replaced by its first kind in brackets; n_chars follows."""
    found = find(docs, model, **how)
    by_place = "array_sort(_spans, (a, b) -> if(a.bstart <> b.bstart, a.bstart - b.bstart, b.bend - a.bend))"
    raw = "cast(_text as binary)"
    reached = running("transform(spans, s -> s.bend)", lambda a, b: f"greatest({a}, {b})")  # where the spans before end
    kept = f"filter(zip_with(spans, {reached}, (s, n) -> named_struct('s', s, 'to', n)), r -> r.s.bstart >= r.to)"
    pieces = f"transform({kept}, r -> concat(string(substring({raw}, int(r.to + 1), int(r.s.bstart - r.to))), '[', upper(r.s.kind), ']'))"
    rest = f"string(substring({raw}, array_max(transform(spans, s -> s.bend)) + 1, octet_length(_text)))"
    whole = F.expr(let(by_place, "spans", f"concat(array_join({pieces}, ''), {rest})"))
    text = F.when(F.size("_spans") > 0, whole).otherwise(F.col("text"))
    columns = []
    for f in docs.schema:
        if f.name == "text":
            columns.append(text.alias("text"))
        elif f.name == "n_chars":
            columns.append(F.when(F.size("_spans") > 0, F.length(whole).cast(f.dataType)).otherwise(F.col("n_chars")).alias("n_chars"))
        else:
            columns.append(F.col(f"`{f.name}`"))
    return found.select(*columns)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    from .common import table

    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *(F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS[:4]), F.sha2(joined(F.col("_base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("_spans")).alias("spans"), F.size("_added").cast("long").alias("n_added")
    )
