"""Unified diffs as column expressions and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeprism.functions.text import language as text_language


def line_counts(patch: Column) -> tuple[Column, Column]:
    """(added, removed) lines; file headers are no changes."""
    lines = F.split(F.coalesce(patch, F.lit("")), "\n")
    plus = F.size(F.filter(lines, lambda x: x.startswith("+") & ~x.startswith("+++")))
    minus = F.size(F.filter(lines, lambda x: x.startswith("-") & ~x.startswith("---")))
    return plus, minus


def hunks(patch: Column) -> Column:
    """array<struct<old_start, old_count, new_start, new_count>>; an omitted count is 1."""
    heads = F.filter(F.split(F.coalesce(patch, F.lit("")), "\n"), lambda x: x.rlike(r"^@@ -\d+(,\d+)? \+\d+(,\d+)? @@"))
    part = lambda x, i: F.regexp_extract(x, r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", i)
    num = lambda x, i: F.when(part(x, i) == "", 1).otherwise(F.expr("0") + part(x, i).try_cast("int"))
    return F.transform(heads, lambda x: F.struct(num(x, 1).alias("old_start"), num(x, 2).alias("old_count"), num(x, 3).alias("new_start"), num(x, 4).alias("new_count")))


def parse_diff(diffs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, path, change_type, old_path, added, removed, hunks) of each file of a diff; each file keeps its own hunks."""
    body = F.explode(F.filter(F.split(F.concat(F.lit("\n"), text), r"\ndiff --git "), lambda x: x.startswith("a/")))
    f = diffs.select(key, body.alias("part"))
    old, new = F.regexp_extract("part", r"^a/(.+?) b/", 1), F.regexp_extract("part", r"^a/.+? b/([^\n]+)", 1)
    kind = F.when(F.col("part").rlike(r"\nnew file mode"), "added").when(F.col("part").rlike(r"\ndeleted file mode"), "deleted").when(F.col("part").rlike(r"\nrename from "), "renamed").otherwise("modified")
    plus, minus = line_counts(F.col("part"))
    return f.select(key, F.when(kind == "deleted", old).otherwise(new).alias("path"), kind.alias("change_type"), old.alias("old_path"), plus.alias("added"), minus.alias("removed"), hunks(F.col("part")).alias("hunks"))


def line_range(hunks_: Column) -> Column:
    """struct<first, last> of the new lines that hunks span; 0 and 0 without hunks."""
    first = F.array_min(F.transform(hunks_, lambda h: h["new_start"]))
    last = F.array_max(F.transform(hunks_, lambda h: h["new_start"] + h["new_count"] - 1))
    return F.struct(F.coalesce(first, F.lit(0)).alias("first"), F.coalesce(last, F.lit(0)).alias("last"))


def matching_path(path: Column, paths: Column) -> Column:
    """The one of ``paths`` that is meant by ``path``: as written, without or with a slash before it, or the least that ends
    with it; null if there is none."""
    bare = F.regexp_replace(path, "^/", "")
    has = lambda p: F.array_contains(paths, p)
    return F.when(has(path), path).when(has(bare), bare).when(has(F.concat(F.lit("/"), bare)), F.concat(F.lit("/"), bare)).otherwise(F.array_min(F.filter(paths, lambda p: p.endswith(path))))


def changed_lines(patch: Column) -> Column:
    """array<int>: numbers of the new lines that a patch adds, hunk by hunk."""
    lines = F.split(F.coalesce(patch, F.lit("")), "\n")
    head = r"^@@ -\d+(?:,\d+)? \+(\d+)"
    zero = F.struct(F.lit(None).cast("int").alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc, x):
        start = F.regexp_extract(x, head, 1)
        new = start != ""
        plus = x.startswith("+") & ~x.startswith("+++")
        moves = ~x.startswith("-") & ~x.startswith("\\")
        at = F.when(new, start.try_cast("int")).otherwise(F.when(moves, acc["at"] + 1).otherwise(acc["at"]))
        return F.struct(at.alias("at"), F.when(~new & plus & acc["at"].isNotNull(), F.concat(acc["out"], F.array(acc["at"]))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(lines, zero, step)["out"]


def line_delta(old: Column, new: Column) -> Column:
    """struct<added, deleted>: by how many lines a snippet grew or shrank; an empty snippet has no lines."""
    n = lambda c: F.when(F.coalesce(c, F.lit("")) == "", 0).otherwise(F.size(F.split(c, "\n")))
    return F.struct(F.greatest(n(new) - n(old), F.lit(0)).alias("added"), F.greatest(n(old) - n(new), F.lit(0)).alias("deleted"))


#: Beginnings of functions at the margin, by language (fixed values).
FUNCTION_START = {
    "go": r"^func\s", "python": r"^(?:async\s+)?(?:def|class)\s", "javascript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const)\s", "typescript": r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function|class|const|interface)\s",
    "java": r"^(?:public|private|protected|static|class|interface)\s", "rust": r"^(?:pub\s+)?(?:fn|impl|struct|trait)\s", "ruby": r"^(?:def|class|module)\s", "c": r"^\w[\w\s*]*\(", "cpp": r"^(?:class\s|\w[\w\s:*&<>]*\()",
}


def hunk_chunks(patch: Column, most: int = 102_400) -> Column:
    """array<string>: a patch in chunks that end before the hunk at which they have passed ``most`` characters."""
    parts = F.filter(F.split(F.coalesce(patch, F.lit("")), r"\n(?=@@ )"), lambda x: x != "")
    empty = F.array().cast("array<string>")

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        full = last.isNull() | (F.length(last) > most)
        return F.when(full, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.concat_ws("\n", last, x))))

    return F.aggregate(parts, empty, step)


def function_chunks(content: Column, language: Column, most: int = 102_400, lines_each: int = 3000, chunks: int = 10) -> Column:
    """array<struct<first, lines>>: a new file in at most ``chunks`` chunks (0: all) of whole functions, ``most`` characters
    or one longer function each; of other languages ``lines_each`` lines each. Lines count from 0."""
    lines = F.split(F.coalesce(content, F.lit("")), "\n")
    start = F.lit(None).cast("string")
    for name, pattern in FUNCTION_START.items():
        start = F.when(language == name, F.lit(pattern)).otherwise(start)
    size = F.size(lines)
    heads = F.filter(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.coalesce(F.rlike(F.try_element_at(lines, (i + 1).cast("int")), start), F.lit(False)))
    edges = F.concat(F.array(F.lit(0)), heads)
    block = F.transform(edges, lambda a, i: F.struct(a.alias("first"), (F.coalesce(F.get(edges, i + 1), size) - a).alias("lines")))
    chars = lambda b: F.aggregate(F.slice(lines, (b["first"] + 1).cast("int"), F.greatest(b["lines"], F.lit(0)).cast("int")), F.lit(0), lambda s, x: s + F.length(x))
    zero = F.array().cast("array<struct<first:int,lines:int,chars:int>>")

    def step(acc, b):
        last, n = F.try_element_at(acc, F.lit(-1)), chars(b)
        fits = last.isNotNull() & (last["chars"] + n <= most)
        more = F.struct(last["first"].alias("first"), (last["lines"] + b["lines"]).cast("int").alias("lines"), (last["chars"] + n).cast("int").alias("chars"))
        own = F.struct(b["first"].cast("int").alias("first"), b["lines"].cast("int").alias("lines"), n.cast("int").alias("chars"))
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(more))).otherwise(F.concat(acc, F.array(own)))

    by_function = F.transform(F.aggregate(block, zero, step), lambda x: F.struct(x["first"].alias("first"), x["lines"].alias("lines")))
    by_lines = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((size - 1) / lines_each), F.lit(0)).cast("int")), lambda k: F.struct((k * lines_each).alias("first"), F.least(F.lit(lines_each), size - k * lines_each).alias("lines")))
    out = F.when(start.isNotNull(), by_function).otherwise(by_lines)
    return F.slice(out, 1, chunks) if chunks else out


#: What the pre-filter of files leaves out and keeps (fixed values).
SKIP_SUFFIX = (".json", ".lock", ".sum", ".mod", ".yml", ".yaml", ".toml", ".md", ".txt", ".gitignore", ".dockerignore", "Dockerfile", "Makefile", ".sh", ".sql")
SKIP_PATTERN = ("_generated.go", ".pb.go", ".min.js", ".bundle.js", "dist/", "build/", "node_modules/", "vendor/", ".next/", ".cache/")
PARSED_SUFFIX = (".ts", ".tsx", ".js", ".jsx", ".py", ".go", ".rs", ".java", ".c", ".cpp", ".h", ".hpp", ".rb", ".php", ".swift", ".kt", ".scala")
DOC_SUFFIX = (".md", ".mdx", ".txt", ".rst", ".adoc")
CONFIG_SUFFIX = (".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".lock", ".sum", ".mod", ".env")
BINARY_SUFFIX = (".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz", ".tar", ".exe", ".dll", ".so", ".dylib", ".bin", ".woff", ".woff2", ".ttf", ".eot", ".mp3", ".mp4", ".jar", ".class", ".pyc", ".o", ".a", ".wasm")
CODE_SUFFIX = (
    ".go", ".py", ".js", ".ts", ".tsx", ".jsx", ".java", ".c", ".cpp", ".h", ".hpp", ".cc", ".cxx", ".rs", ".rb", ".php", ".swift", ".kt", ".kts", ".scala", ".clj", ".cljs", ".ex", ".exs", ".sh", ".bash", ".zsh", ".ps1", ".cs", ".fs", ".vb", ".sql",
)


def _ends(c: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for x in suffixes:
        out = out | c.endswith(x)
    return out


def skip_reason(path: Column, deleted: Column, size: Column) -> Column:
    """Why a changed file is not read for code, by the first rule that holds; null if it is read."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    dot = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    ext = F.when(dot == "", base).otherwise(dot)
    made = F.lit(False)
    for p in SKIP_PATTERN:
        made = made | path.contains(p)
    return F.when(deleted, "deleted").when(size > 50 * 1024, "large").when(ext.isin(*SKIP_SUFFIX), "config").when(made, "generated").when(~ext.isin(*PARSED_SUFFIX), "unknown")


def code_file(path: Column) -> Column:
    """Whether a path is source code: no binary, document, configuration or dot file, and of a known extension."""
    low, base = F.lower(path), F.regexp_extract(path, r"([^/]*)$", 1)
    return ~_ends(low, BINARY_SUFFIX) & ~_ends(low, DOC_SUFFIX) & ~_ends(low, CONFIG_SUFFIX) & ~base.startswith(".") & _ends(low, CODE_SUFFIX)


def extracted_chunks(files: DataFrame, each: int = 10) -> DataFrame:
    """(repo_id, sha, filename, kind, number, batch, content, skipped) of the code files of commits: an added file by its
    functions, a modified or renamed one by its hunks, the first ``each`` of them with the count of those left out, in batches of ten.

    ``files``: (repo_id, sha, filename, status, patch).
    """
    f = files.where(code_file(F.col("filename")) & (F.coalesce("status", F.lit("modified")) != "removed") & F.col("patch").isNotNull())
    body = F.array_join(F.transform(F.filter(F.split("patch", "\n"), lambda x: x.startswith("+")), lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")
    f = f.withColumn("kind", F.when(F.col("status") == "added", "function").otherwise("hunk")).withColumn("body", F.when(F.col("kind") == "function", body))
    parts = F.transform(function_chunks(F.col("body"), text_language(F.col("filename")), chunks=0), lambda c: F.array_join(F.slice(F.split("body", "\n"), (c["first"] + 1).cast("int"), c["lines"].cast("int")), "\n"))
    f = f.withColumn("parts", F.when(F.col("kind") == "function", parts).otherwise(hunk_chunks(F.col("patch"))))
    kept = f.select("repo_id", "sha", "filename", "kind", F.greatest(F.size("parts") - each, F.lit(0)).alias("skipped"), F.posexplode(F.slice("parts", 1, each)).alias("number", "content"))
    return kept.select("repo_id", "sha", "filename", "kind", "number", F.floor(F.col("number") / 10).cast("int").alias("batch"), "content", "skipped")
