"""Text expressions: lines, counts, hashes, names, languages, frameworks and chunk metadata. All JVM-side."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import config

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, f) -> Column:
    """f(value) with the value computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def lines(text: Column | str) -> Column:
    """Lines at all Unicode breaks, without an empty last one; the empty text has none."""
    parts = F.split(col(text), LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def fold(text: Column | str) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(col(text), UPPER, LOWER)


def like(text: Column | str, query: str) -> Column:
    """text LIKE %query% with A-Z folded; % and _ of the query are wildcards and the backslash is plain."""
    return fold(text).like("%" + query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\") + "%")


def non_blank_length(text: Column | str) -> Column:
    return F.length(F.regexp_replace(col(text), r"(?U)[\s\x1c-\x1f]", ""))


def token_count(text: Column | str) -> Column:
    """A fourth of the characters, rounded down: the count without a vocabulary at hand."""
    return F.floor(F.length(col(text)) / 4).cast("int")


def content_hash(text: Column | str) -> Column:
    return F.sha2(col(text).cast("binary"), 256)


def line_slice(text: Column | str, start: Column | int, end: Column | int) -> Column:
    """Lines [start, end), 0-based, joined by line feeds."""
    a = F.lit(start) if isinstance(start, int) else start
    b = F.lit(end) if isinstance(end, int) else end
    return F.array_join(F.slice(lines(text), a + 1, F.greatest(b - a, F.lit(0))), "\n")


def truncate(text: Column | str, most: int, keep: int | None = None, tail: str = "...") -> Column:
    """At most `most` characters, else the first `keep` (default most - 3) and the tail."""
    t = col(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - len(tail) if keep is None else keep), F.lit(tail))).otherwise(t)


def escape_regex(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"([.*+?^${}()|\[\]\\])", r"\\$1")


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def extension(path: Column | str) -> Column:
    """With its dot, as written; empty without one or for a dot file's only dot."""
    return F.regexp_extract(base_name(path), r"[^.](\.[^.]*)$", 1)


def lookup(pairs: dict[str, str], key: Column, default: Column | None = None) -> Column:
    m = F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))
    return F.coalesce(F.try_element_at(m, key), default if default is not None else F.lit(None).cast("string"))


def language_of(path: Column | str) -> Column:
    return lookup(config.LANGUAGE_BY_EXTENSION, F.lower(extension(path)), F.lit("unknown"))


def framework_of_file(text: Column | str) -> Column:
    t, out = col(text), F.lit(None).cast("string")
    for name, words in reversed(config.FRAMEWORK_WORDS.items()):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(t, F.lit(w))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def framework_of_chunk(text: Column | str) -> Column:
    t, out = col(text), F.lit(None).cast("string")
    for name, patterns in reversed(config.FRAMEWORK_PATTERNS.items()):
        out = F.when(t.rlike("(?U)" + "|".join(f"(?:{p})" for p in patterns)), F.lit(name)).otherwise(out)
    return out


def pattern_hits(ls: Column, patterns: tuple[str, ...]) -> Column:
    """Sum over patterns of the lines each hits."""
    def hits(s: Column) -> Column:
        total = F.lit(0)
        for p in patterns:
            total = total + s.rlike("(?U)" + p).cast("int")
        return total

    return F.aggregate(F.transform(ls, hits), F.lit(0), lambda a, v: a + v)


def per_language(language: Column, make, default: Column) -> Column:
    out = default
    for name, settings in config.LANGUAGES.items():
        if name != "default":
            out = F.when(language == name, make(settings)).otherwise(out)
    return out


def ratios(text: Column | str, language: Column) -> tuple[Column, Column]:
    """(ignored, structural) hits per line; null for a blank text."""
    def share(which: str) -> Column:
        def of(ls: Column) -> Column:
            hits = per_language(language, lambda s: pattern_hits(ls, getattr(s, which)) if getattr(s, which) else F.lit(0), F.lit(0))
            return F.when(F.size(ls) > 0, hits / F.size(ls))

        return let(lines(text), of)

    return share("ignored"), share("structure")


def quality(ignored: Column, structure: Column) -> Column:
    """1 - ignored + structure, 0 for a blank text; neither bounded."""
    return F.coalesce(1 - ignored + structure, F.lit(0.0))


def chunk_type(ignored: Column, structure: Column) -> Column:
    return F.when(ignored.isNull(), "empty").when(ignored > 0.7, "imports").when(ignored > 0.3, "mixed").when(structure > 0.3, "structural").otherwise("code")


def special_flags(text: Column | str, language: Column) -> Column:
    """The names of the language's special patterns that occur."""
    t, none = col(text), F.array().cast("array<string>")
    return per_language(language, lambda s: F.array_compact(F.array(*(F.when(t.rlike("(?U)" + p), F.lit(k)) for k, p in s.special.items()))) if s.special else none, none)


def structure_points(text: Column | str, language: Column) -> Column:
    """0-based lines that a structural pattern hits, in order."""
    none = F.array().cast("array<int>")

    def of(s: config.Language) -> Column:
        p = "(?U)" + "|".join(f"(?:{x})" for x in s.structure)
        return F.array_compact(F.transform(lines(text), lambda x, i: F.when(x.rlike(p), i))) if s.structure else none

    return per_language(language, of, none)


def markdown_type(text: Column | str) -> Column:
    t = col(text)
    return F.when(F.contains(t, F.lit("```")), "code_block").when(t.rlike(r"(?m)^#{1,6}\s+"), "section").when(t.rlike(r"(?m)^\s*[-*+]\s+|^\s*\d+\.\s+"), "list").otherwise("text")


def title(text: Column | str, start: Column, end: Column) -> Column:
    """The first heading, else the chunk's lines."""
    head = F.regexp_extract(col(text), r"(?m)^#{1,6}\s+(.+)$", 1)
    return F.when(head != "", F.trim(head)).otherwise(F.format_string("Chunk %s-%s", start.cast("string"), end.cast("string")))


def duration(seconds: Column) -> Column:
    """Seconds as s, minutes or hours with two places, halves rounded up."""

    def shown(per: int, unit: str) -> Column:
        return let(F.floor(seconds * 100 / per + 0.5), lambda n: F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"), F.lit(unit)))

    return F.when(seconds < 60, shown(1, "s")).when(seconds < 3600, shown(60, "min")).otherwise(shown(3600, "hr"))


def is_pascal_case(name: Column | str) -> Column:
    return col(name).rlike(r"^[A-Z][A-Za-z0-9]*$")


def has_markup(text: Column | str) -> Column:
    """A tag of an embedded component or element."""
    return col(text).rlike(r"<[A-Za-z][A-Za-z0-9.]*(\s|>|/)")


def is_hook_name(name: Column | str) -> Column:
    return col(name).rlike(r"^use[A-Z]")


def min_indent(text: Column | str) -> Column:
    """The least positive indentation of a line that isn't blank; 0 without one."""
    indents = F.transform(F.filter(lines(text), lambda s: F.trim(s) != ""), lambda s: F.length(F.regexp_extract(s, r"^\s*", 0)))
    return F.coalesce(F.array_min(F.filter(indents, lambda i: i > 0)), F.lit(0))


def prepare(text: Column | str, strip_unindented: bool = False) -> Column:
    """Runs of blank lines collapsed, and the common indentation taken off indented lines.

    strip_unindented also cuts the first characters of lines without indentation, as the original method does.
    """
    t = F.regexp_replace(col(text), r"\n{3,}", "\n\n")

    def stripped(x: Column) -> Column:
        cut = x["cut"]
        able = lambda s: (F.length(s) > cut) & (F.trim(s) != "") & (F.lit(True) if strip_unindented else s.rlike(r"^\s"))
        return F.array_join(F.transform(x["ls"], lambda s: F.when((cut > 0) & able(s), F.substring(s, cut + 1, F.length(s))).otherwise(s)), "\n")

    return let(F.struct(min_indent(t).alias("cut"), lines(t).alias("ls")), stripped)


def with_context(text: Column, language: Column, framework: Column, kind: Column, name: Column | None = None) -> Column:
    """What is embedded: a line for each known property, then the text."""
    parts = [("Language", language), ("Framework", framework), ("Type", kind)] + ([("Name", name)] if name is not None else [])
    head = F.concat_ws("\n", *(F.when(c.isNotNull(), F.concat(F.lit(f"{k}: "), c)) for k, c in parts))
    return F.when(head != "", F.concat(head, F.lit("\n\n"), text)).otherwise(text)


def valid_regex(pattern: str) -> bool:
    try:
        re.compile(pattern)
        return True
    except re.error:
        return False


def matches(line: Column | str, pattern: str, case_sensitive: bool = True) -> Column:
    """A regular expression found in the line; a pattern that isn't one is looked for as it stands."""
    s = col(line)
    if valid_regex(pattern):
        return s.rlike("(?U)" + ("" if case_sensitive else "(?iu)") + pattern)
    return F.contains(s, F.lit(pattern)) if case_sensitive else F.contains(F.lower(s), F.lit(pattern.lower()))
