"""Regular-expression search over lines: filters on paths, ranking of files, context, multiple patterns, formatting."""

from __future__ import annotations

import bisect
import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .search import glob_regex


def exploded(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """(path, line_number from 1, line)."""
    return files.select(F.col(path).alias("path"), F.posexplode(X.lines(text)).alias("pos", "line")).select("path", (F.col("pos") + 1).alias("line_number"), "line")


def is_hidden(path: Column | str, entry_only: bool = False) -> Column:
    """A part of the path, or only its last one, begins with a dot."""
    parts = F.filter(F.split(X.col(path), "/"), lambda p: ~p.isin("", ".", ".."))
    return F.coalesce(F.element_at(parts, -1).startswith("."), F.lit(False)) if entry_only else F.exists(parts, lambda p: p.startswith("."))


def ignore_rules(text: str) -> list[str]:
    """Patterns of an ignore file: no blanks, comments or closing slash; order and first occurrence kept."""
    rules = (s.strip() for s in text.splitlines())
    return list(dict.fromkeys(r.rstrip("/") for r in rules if r and not r.startswith("#")))


def is_ignored(path: Column | str, rules: list[str], parent: bool = True) -> Column:
    """With a slash, the rule is a glob over the path or over what lies below; with a star, over the name; else it equals the name, the path or,
    where parent holds, the name of the folder that holds the file. No negation, no anchors; * crosses slashes."""
    p = X.col(path)
    name, above = X.base_name(p), F.coalesce(F.try_element_at(F.split(p, "/"), F.lit(-2)), F.lit(""))
    out = F.lit(False)
    globs = [g for r in rules if "/" in r for g in (r, f"{r}/*")]
    if globs:
        out = out | p.rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    stars = [r for r in rules if "/" not in r and "*" in r]
    if stars:
        out = out | name.rlike("|".join(f"(?:{glob_regex(g)})" for g in stars))
    plain = [r for r in rules if "/" not in r and "*" not in r]
    if plain:
        out = out | name.isin(plain) | p.isin(plain) | (above.isin(plain) if parent else F.lit(False))
    return out


def has_extension(path: Column | str, extensions: str | list[str] | None) -> Column:
    """A comma list, in any case, with or without dots; an empty one lets all pass."""
    wanted = extensions.split(",") if isinstance(extensions, str) else list(extensions or [])
    wanted = [e.strip().lower().lstrip("*").lstrip(".") for e in wanted if e.strip()]
    if not wanted:
        return F.lit(True)
    return F.lower(F.regexp_extract(X.base_name(path), r"\.([^.]+)$", 1)).isin(wanted)


def in_globs(path: Column | str, include: str | None = None, exclude: str | None = None) -> Column:
    p, ok = X.col(path), F.lit(True)
    if include:
        ok = ok & p.rlike(glob_regex(include))
    return ok & ~p.rlike(glob_regex(exclude)) if exclude else ok


def any_match(line: Column | str, query: str, case_sensitive: bool = True) -> Column:
    """Any of the comma-separated patterns, in one pass over the lines."""
    out = F.lit(False)
    for p in [q.strip() for q in query.split(",") if q.strip()] or [query]:
        out = out | X.matches(line, p, case_sensitive)
    return out


def grep(lines: DataFrame, query: str, case_sensitive: bool = True) -> DataFrame:
    """The lines that match."""
    return lines.where(any_match("line", query, case_sensitive))


def first_matches(lines: DataFrame, query: str, most: int = 100, case_sensitive: bool = True) -> DataFrame:
    """At most max(most, 50) matches, by path and line."""
    return grep(lines, query, case_sensitive).orderBy("path", "line_number").limit(max(most, 50))


def match_counts(matched: DataFrame) -> DataFrame:
    return matched.groupBy("path").agg(F.count("*").alias("matches"))


def top_files(matched: DataFrame, k: int = 20) -> DataFrame:
    """(path, matches) of the k files with most matches, ties by path."""
    return match_counts(matched).orderBy(F.desc("matches"), "path").limit(k)


def with_context(lines: DataFrame, is_match: Column, around: int = 1) -> DataFrame:
    """Each match and the lines around it, once: path, line_number, line, is_match."""
    near = Window.partitionBy("path").orderBy("line_number").rangeBetween(-around, around)
    hit = lines.withColumn("is_match", is_match)
    return hit.withColumn("near", F.max("is_match").over(near)).where("near").drop("near")


def enclosing(lines: DataFrame, is_match: Column) -> DataFrame:
    """Each match with the lines that enclose it by indentation: those above with less indentation than every line between."""
    kind = lines.schema["path"].dataType.simpleString()
    marked = lines.select("path", "line_number", "line", F.length(F.regexp_extract("line", r"^\s*", 0)).alias("indent"), (F.trim("line") == "").alias("blank"), is_match.alias("is_match"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("line_number", kind="stable").reset_index(drop=True)
        above, open_, shown = [], [], set()  # above: of each line the nearest one above with less indentation; open_: (indent, line), indents growing
        for i, (n, blank, hit) in enumerate(zip(pdf.indent.tolist(), pdf.blank.tolist(), pdf.is_match.tolist(), strict=True)):
            while open_ and open_[-1][0] >= n and not blank:
                open_.pop()
            at = bisect.bisect_left(open_, (n,))
            k = open_[at - 1][1] if at else -1
            above.append(k)
            if not blank:
                open_.append((n, i))
            while hit and k >= 0 and k not in shown:
                shown.add(k)
                k = above[k]
        keep = pdf.is_match | pdf.index.isin(shown)
        return pdf[keep][["path", "line_number", "line", "is_match"]]

    return marked.groupBy("path").applyInPandas(run, f"path {kind}, line_number int, line string, is_match boolean")


def search(files: DataFrame, query: str, extensions: str | None = None, case_sensitive: bool = True, most_files: int = 20, rules: list[str] | None = None, around: int = 1, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Files (path, text) that are neither hidden nor ignored, the best by matches, with context lines and the file's rank."""
    kept = files.where(~is_hidden("path") & ~is_ignored("path", rules or []) & has_extension("path", extensions) & in_globs("path", include, exclude))
    ls = exploded(kept)
    best = top_files(grep(ls, query, case_sensitive), most_files).withColumn("file_rank", F.row_number().over(Window.orderBy(F.desc("matches"), "path")))
    return with_context(ls.join(F.broadcast(best), "path"), any_match("line", query, case_sensitive), around)


def formatted(hits: DataFrame) -> DataFrame:
    """(path, line_number, output): a header before each file's first line, a full block for matches and a thin one for context."""
    mark = F.when(F.col("is_match"), "█").otherwise("│")
    first = F.row_number().over(Window.partitionBy("path").orderBy("line_number")) == 1
    row = F.concat(F.lit("  "), mark, F.lit(" "), F.col("line_number").cast("string"), F.lit(": "), F.col("line"))
    return hits.select("path", "line_number", F.when(first, F.concat(F.lit("\n"), F.col("path"), F.lit(":\n"), row)).otherwise(row).alias("output"))


def glob_match(name: str, pattern: str) -> bool:
    """For tests: what glob_regex must do."""
    return fnmatch.fnmatchcase(name, pattern)
