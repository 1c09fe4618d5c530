"""Files and folders as tables: scans, decoding, binary detection, conversion, bounded reads and listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.config import INDEXED_EXTENSIONS
from ..operators.grep import is_hidden, is_ignored

#: FIXED VALUES: sizes and shares that make a file binary; extensions that always do; fence names by extension.
MOST_BYTES, SNIFFED, CONTROL_SHARE, CONTROL_LEAST = 10 * 1024 * 1024, 1024, 0.3, 50
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".tiff", ".webp", ".mp3", ".mp4", ".avi", ".mov", ".wav", ".flac", ".zip", ".tar", ".gz", ".rar", ".7z", ".bz2", ".exe", ".dll", ".so", ".dylib", ".bin", ".class", ".jar",
    ".pyc", ".o", ".a", ".db", ".sqlite",
)
FENCES = {".py": "python", ".js": "javascript", ".jsx": "jsx", ".ts": "typescript", ".tsx": "tsx", ".java": "java", ".go": "go", ".html": "html", ".css": "css", ".cpp": "cpp", ".c": "c", ".rb": "ruby", ".json": "json", ".yaml": "yaml", ".yml": "yaml", ".xml": "xml", ".sh": "bash", ".sql": "sql"}


def scan(spark: SparkSession, root: str, extensions: tuple[str, ...] | None = INDEXED_EXTENSIONS, recursive: bool = True) -> DataFrame:
    """(path, name, length, modified, content) of the files under root whose name ends so, as written; None takes all. The glob reaches the listing; Spark's reader leaves empty files out."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extensions and len(extensions) == 1:
        reader = reader.option("pathGlobFilter", f"*{extensions[0]}")
    df = reader.load(root).select("path", X.base_name("path").alias("name"), "length", F.col("modificationTime").alias("modified"), "content")
    if not recursive:
        df = df.where(~F.contains(F.regexp_replace(F.element_at(F.split("path", _quoted(root.rstrip("/").split("/")[-1] + "/"), 2), -1), "^/", ""), F.lit("/")))
    if extensions:
        ok = F.lit(False)
        for e in extensions:
            ok = ok | F.col("name").endswith(e)
        df = df.where(ok)
    return df


def _quoted(s: str) -> str:
    return r"\Q" + s + r"\E"


def decoded(df: DataFrame, on_error: str = "strict") -> DataFrame:
    """Adds text and error. strict: no text but an error where the bytes aren't UTF-8; latin1: read as that instead; replace: bad bytes become U+FFFD."""
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    good = F.when(valid, F.decode("content", "UTF-8"))
    if on_error == "latin1":
        return df.withColumn("text", F.coalesce(good, F.decode("content", "ISO-8859-1"))).withColumn("error", F.lit(None).cast("string"))
    if on_error == "replace":
        return df.withColumn("text", F.make_valid_utf8(F.col("content").cast("string"))).withColumn("error", F.lit(None).cast("string"))
    return df.withColumn("text", good).withColumn("error", F.when(~valid, "not UTF-8"))


def is_binary(path: Column | str, length: Column | str, content: Column | str) -> Column:
    """By extension, size, an early NUL byte, or the share of control bytes among the first ones; an empty file counts as binary."""
    head = F.substring(X.col(content), 1, SNIFFED)
    hexes = F.hex(head)
    n = F.length(head)
    pairs = F.regexp_replace(hexes, "(..)", "$1 ")
    control = F.size(F.regexp_extract_all(pairs, F.lit("(?:0[0-8BEF]|1[0-9A-F]|7F) "), F.lit(0)))
    nul = F.contains(F.concat(F.lit(" "), pairs), F.lit(" 00 "))
    size = X.col(length)
    return F.lower(X.extension(path)).isin(list(BINARY_EXTENSIONS)) | (size > MOST_BYTES) | (size == 0) | nul | ((n > CONTROL_LEAST) & (control / n > CONTROL_SHARE))


def as_markdown(path: Column | str, text: Column | str) -> Column:
    """Markdown and plain text as they are, HTML without tags and with headings and lists marked, other text in a fence of its language."""
    t, ext = X.col(text), F.lower(X.extension(path))
    return F.when(ext.isin(".md", ".markdown", ".txt"), t).when(ext.isin(".html", ".htm"), html_as_markdown(t)).otherwise(F.concat(F.lit("```"), X.lookup(FENCES, ext, F.lit("")), F.lit("\n"), t, F.lit("\n```")))


def html_as_markdown(html: Column) -> Column:
    s = F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>|<!--.*?-->", "")
    s = F.regexp_replace(s, r"(?i)<h([1-6])[^>]*>", "\n## ")
    for pattern, mark in ((r"(?i)<li[^>]*>", "\n- "), (r"(?i)<p[^>]*>", "\n\n"), (r"(?i)<(br|div|tr)[^>]*>|</h[1-6]>", "\n")):
        s = F.regexp_replace(s, pattern, mark)
    s = F.regexp_replace(s, r"<[^>]+>", "")
    for name, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(name), F.lit(c))
    return F.trim(F.regexp_replace(s, r"\n{3,}", "\n\n"))


def sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Structure that was parsed before, as JSON; it takes precedence over parsing where both are at hand (coalesce)."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def bounded(text: Column | str, start: int = 1, end: int | None = None, most: int = 500) -> Column:
    """struct(content, start_line, end_line, total_lines, truncated, lines_before, lines_after): lines are counted from 1, both ends in."""
    ls = X.lines(text)
    total, a = F.size(ls), max(start, 1)
    b = F.least(F.lit(end if end is not None else a + most - 1), total)
    b = F.when(b - a + 1 > most, a + most - 1).otherwise(b)
    content = F.array_join(F.slice(ls, a, F.greatest(b - a + 1, F.lit(0))), "\n")
    return F.struct(
        content.alias("content"), F.lit(a).alias("start_line"), b.alias("end_line"), total.alias("total_lines"), ((F.lit(a) > 1) | (b < total)).alias("truncated"), F.lit(a - 1).alias("lines_before"), (total - b).alias("lines_after")
    )


def read_file(files: DataFrame, path: str, start: int = 1, end: int | None = None, most: int = 500) -> DataFrame:
    return files.where(F.col("path") == path).select("path", bounded("text", start, end, most).alias("r")).select("path", "r.*")


def entries(paths: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Files and the folders above them: path, parent, name, depth (from 1), is_directory; hidden and ignored ones, and what lies under them, are left out."""
    p = paths.select("path").where(~is_hidden("path"))
    parts = F.split("path", "/")
    up = p.select("path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("i", "sub"), F.size(parts).alias("n"))
    out = up.select(F.col("sub").alias("path"), (F.col("i") + 1).alias("depth"), (F.col("i") + 1 < F.col("n")).alias("is_directory")).distinct()
    out = out.withColumns({"parent": F.regexp_extract("path", "^(.*)/[^/]*$", 1), "name": X.base_name("path")})
    if rules:
        gone = out.where(is_ignored("path", rules, parent=False)).select(F.col("path").alias("gone"))
        chain = up.select(F.element_at(F.split("path", "/"), -1), "path", F.col("sub"))
        dead = chain.join(gone, chain["sub"] == gone["gone"]).select("path").distinct()
        out = out.join(dead, "path", "left_anti").join(gone.withColumnRenamed("gone", "path"), "path", "left_anti")
    return out


def flat_listing(found: DataFrame, folder: str = "", most: int = 100) -> DataFrame:
    """(place, name, is_directory) of one folder by name, and a last row with how many more there are."""
    own = found.where(F.col("parent") == folder)
    shown = own.orderBy("name").limit(most).withColumn("place", F.row_number().over(Window.orderBy("name"))).select("place", "name", "is_directory")  # `most` rows
    more = own.agg((F.count("*") - most).alias("n")).where("n > 0").select(F.lit(most + 1).alias("place"), F.format_string("... (%d more items)", "n").alias("name"), F.lit(False).alias("is_directory"))
    return shown.union(more)


def budgeted_tree(found: DataFrame, most: int = 100, depth: int = 3) -> tuple[list[dict], int]:
    """(entries, how many aren't shown) of a listing cut to `most` entries: in each folder at most half of its budget are files, and the rest is
    shared evenly by its folders, one each at least, down to `depth`. Only names down to that depth come to the driver, and of a folder's files no more than fit."""
    w = Window.partitionBy("parent", "is_directory").orderBy("name")
    near = found.where(F.col("depth") <= depth + 1).withColumn("nth", F.row_number().over(w))
    rows = near.where(F.col("nth") <= most).select("path", "parent", "name", "is_directory").orderBy("path").collect()
    counts = {r.parent: (r.files, r.folders) for r in found.where(F.col("depth") <= depth + 1).groupBy("parent").agg(F.count_if(~F.col("is_directory")).alias("files"), F.count_if("is_directory").alias("folders")).collect()}
    by: dict[str, list] = {}
    for r in rows:
        by.setdefault(r.parent, []).append(r)
    hidden = 0

    def visit(folder: str, budget: int, left: int) -> list[dict]:
        nonlocal hidden
        own = sorted(by.get(folder, []), key=lambda r: r.name)
        files, folders = [r for r in own if not r.is_directory], [r for r in own if r.is_directory]
        n_files, n_folders = counts.get(folder, (0, 0))
        shown = files[: budget // 2] if folders else files[:budget]
        out = [{"path": r.path, "is_directory": False} for r in shown]
        hidden += n_files - len(shown)
        rest = budget - len(shown)
        each = max(1, rest // max(len(folders), 1))
        opened = 0
        for r in folders:
            if rest <= 0:
                break
            out.append({"path": r.path, "is_directory": True})
            opened += 1
            below = visit(r.path, min(each, rest) - 1, left - 1) if left > 0 and min(each, rest) > 1 else []
            if left > 0 and not below:
                hidden += sum(counts.get(r.path, (0, 0)))
            out += below
            rest -= 1 + len(below)
        hidden += n_folders - opened
        return out

    return visit("", most, depth), hidden
