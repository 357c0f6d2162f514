"""Text functions as column expressions: keywords, stems, set similarity, references, addresses, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no meaning for keywords (fixed values).
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of", "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with")
#: Suffixes in the order in which they are tried (fixed values).
SUFFIXES = ("ing", "ed", "es", "s", "er", "ly")


def stem(w: Column) -> Column:
    """``w`` without the first suffix that matches, when more than two letters stay besides."""
    out = None
    for s in SUFFIXES:
        hit = w.endswith(s) & (F.length(w) > len(s) + 2)
        cut = F.substring(w, F.lit(1), F.length(w) - len(s))
        out = F.when(hit, cut) if out is None else out.when(hit, cut)
    return out.otherwise(w)


def keyword_set(text: Column) -> Column:
    """Distinct keywords of a text and their stems."""
    clean = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"https?://[^\s]+", ""), r"\*\*|__|##|```", "")
    words = F.array_distinct(F.regexp_extract_all(clean, F.lit(r"([a-z0-9]+(?:[_-][a-z0-9]+)*)"), F.lit(1)))
    kept = F.filter(words, lambda w: ~w.isin(*STOP_WORDS) & (F.length(w) >= 2) & ~w.rlike(r"^[0-9]+$"))
    # an array of one gives the words a name, so that they are read once
    return F.transform(F.array(kept), lambda k: F.array_distinct(F.concat(k, F.transform(k, stem))))[0]


def keywords(text: Column) -> Column:
    """Distinct keywords of a text and their stems, sorted."""
    return F.array_sort(keyword_set(text))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def packed(words: Column) -> Column:
    """struct<codes array<bigint>, rest array<string>> of keywords: as numbers, which are compared faster, those of 11 letters and
    digits at most, each by a number of its own (base 36 behind a 1); the others as they are."""
    short = lambda w: w.rlike("^[a-z0-9]{1,11}$")
    codes = F.transform(F.filter(words, short), lambda w: F.conv(F.concat(F.lit("1"), w), 36, 10).cast("bigint"))
    return F.struct(codes.alias("codes"), F.filter(words, lambda w: ~short(w)).alias("rest"))


def packed_union(a: Column, b: Column) -> Column:
    return F.struct(*(F.array_union(a[x], b[x]).alias(x) for x in ("codes", "rest")))


def packed_size(a: Column) -> Column:
    return F.size(a["codes"]) + F.size(a["rest"])


def packed_common(a: Column, b: Column) -> Column:
    """How many words two sets share."""
    rest = F.when((F.size(a["rest"]) > 0) & (F.size(b["rest"]) > 0), F.size(F.array_intersect(a["rest"], b["rest"]))).otherwise(0)
    return F.size(F.array_intersect(a["codes"], b["codes"])) + rest


def cosine(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a) * F.size(b)))


def issue_references(title: Column, body: Column) -> Column:
    """Distinct numbers that a closing word points to, in order."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit(""))))
    found = F.regexp_extract_all(text, F.lit(r"(?:fix|fixes|fixed|close|closes|closed|resolve|resolves|resolved)\s+#([0-9]{1,9})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: x.cast("int")))


def plain_email(email: Column) -> Column:
    """An address of the hosting service without the number before the login, if there is exactly one plus sign."""
    parts = F.split(email, r"\+")
    return F.when(email.contains("@users.noreply.") & (F.size(parts) == 2), parts[1]).otherwise(email)


def signature(text: Column) -> Column:
    """A parameter list without blanks and with type aliases levelled."""
    s = F.regexp_replace(text, r"\s+", "")
    s = F.regexp_replace(s, r"int64|int32", "int")
    s = F.regexp_replace(s, r":str(?=[,)])", ":string")
    return F.regexp_replace(s, r":bool(?=[,)]|$)", ":boolean")


def parameter_count(sig: Column) -> Column:
    inner = F.regexp_extract(sig, r"(?s)\((.*)\)", 1)
    return F.when(F.trim(inner) == "", 0).otherwise(F.size(F.split(inner, ",")))


def alike_signatures(a: Column, b: Column) -> Column:
    """Whether two signatures are equal when levelled, or have as many parameters and differ by a fifth at most."""
    a, b = signature(a), signature(b)
    near = F.levenshtein(a, b) <= F.floor(F.greatest(F.length(a), F.length(b)) / 5)
    return (a == b) | ((parameter_count(a) == parameter_count(b)) & near)


#: Words that carry no meaning for the second keyword form (fixed values).
STOP_WORDS_2 = (
    "a", "an", "the", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "can",
    "this", "that", "these", "those",
)


def plain_keywords(text: Column) -> Column:
    """Distinct words of three letters or more between blanks, without punctuation at their ends and stop words, sorted."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+")
    bare = F.transform(words, lambda w: F.regexp_replace(w, r"^[.,!?;:\"'()\[\]{}#]+|[.,!?;:\"'()\[\]{}#]+$", ""))
    return F.array_sort(F.array_distinct(F.filter(bare, lambda w: (F.length(w) >= 3) & ~w.isin(*STOP_WORDS_2))))


def plain_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of plain keywords, 0 where there are none."""
    x, y = plain_keywords(a), plain_keywords(b)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(x, y)), F.size(F.array_union(x, y))), F.lit(0.0))


def issue_similarity(title_a: Column, body_a: Column, title_b: Column, body_b: Column) -> Column:
    """The greater of the similarities of two titles and of two whole texts."""
    whole = lambda t, b: F.concat_ws(" ", F.coalesce(t, F.lit("")), F.coalesce(b, F.lit("")))
    return F.greatest(jaccard(keywords(title_a), keywords(title_b)), jaccard(keywords(whole(title_a, body_a)), keywords(whole(title_b, body_b))))


def snippet(text: Column, ref: Column, around: int = 50) -> Column:
    """``ref`` with the text around it, ... where that is cut; without ``ref`` the beginning of the text."""
    at = F.instr(text, ref)
    start, end = F.greatest(at - around, F.lit(1)), F.least(at + F.length(ref) + around, F.length(text) + 1)
    cut = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(text, start, end - start), F.when(end <= F.length(text), "...").otherwise(""))
    return F.when(at == 0, F.substring(text, F.lit(1), F.lit(2 * around))).otherwise(cut)


def shortened(text: Column, most: int = 2000, head: int = 1000, tail: int = 500) -> Column:
    """A comment of more than ``most`` characters by its beginning, a mark and its end."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, F.lit(1), F.lit(head)), F.lit("...[truncated]..."), F.substring(text, F.length(text) - tail + 1, F.lit(tail)))).otherwise(text)


#: Extensions of files that incidents speak of (fixed values).
PATH_WORD = r"\.(?:go|py|js|ts|java|rb|php|c|cpp|h|rs|sql)$"


def file_paths(text: Column) -> Column:
    """Distinct words of a text that end like a source file, in order, without punctuation at their ends."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: F.regexp_replace(w, r"^[.,;:()\[\]{}\"']+|[.,;:()\[\]{}\"']+$", ""))
    return F.array_distinct(F.filter(words, lambda w: w.rlike(PATH_WORD)))


def suggested_files(description: Column, root_cause: Column) -> Column:
    """array<struct<path, confidence>> of files that an incident names: 0.9 named twice or more, 0.8 in the root cause, else 0.6."""
    whole = F.concat_ws(" ", F.coalesce(description, F.lit("")), F.coalesce(root_cause, F.lit("")))
    times = lambda p: (F.length(whole) - F.length(F.replace(whole, p, F.lit("")))) / F.length(p)
    conf = lambda p: F.when(times(p) > 1, 0.9).when(F.contains(F.coalesce(root_cause, F.lit("")), p), 0.8).otherwise(0.6)
    return F.transform(file_paths(whole), lambda p: F.struct(p.alias("path"), conf(p).alias("confidence")))


def repository_of(url: Column) -> Column:
    """struct<owner, name> of a repository address, https or ssh; null if it is none."""
    m = lambda i: F.regexp_extract(url, r"^(?:https?://(?:[^/@\s]+@)?[^/\s]+/|(?:ssh://)?[\w.-]+@[^:/\s]+[:/])([^/\s]+)/([^/\s]+?)(?:\.git)?/?$", i)
    return F.when(m(1) != "", F.struct(m(1).alias("owner"), m(2).alias("name")))


def file_kind(path: Column) -> Column:
    """test, config or docs by the path, in this order; else source."""
    low = F.lower(path)
    return F.when(low.contains("test"), "test").when(low.contains("config"), "config").when(low.rlike(r"\.(?:md|txt|doc)$"), "docs").otherwise("source")


def test_names(path: Column) -> Column:
    """Paths at which the tests of a source file would lie; empty for other languages."""
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    ext = F.regexp_extract(base, r"(\.[^.]*)$", 1)
    stem_ = F.substring(base, F.lit(1), F.length(base) - F.length(ext))
    py = F.array(F.concat(folder, F.lit("test_"), base), F.concat(folder, stem_, F.lit("_test.py")), F.concat(folder, F.lit("tests/test_"), base))
    js = F.array(F.concat(folder, stem_, F.lit(".test"), ext), F.concat(folder, stem_, F.lit(".spec"), ext), F.concat(folder, F.lit("__tests__/"), base))
    go = F.array(F.concat(folder, stem_, F.lit("_test.go")))
    return F.when(ext == ".py", py).when(ext.isin(".js", ".ts", ".jsx", ".tsx"), js).when(ext == ".go", go).otherwise(F.array().cast("array<string>"))


def code_density(line: Column) -> Column:
    """How much code a line holds: calls and blocks twice, assignments, dots and words once; comments and blanks 0."""
    bare = F.trim(F.regexp_replace(F.trim(line), r"^[+-]", ""))
    n = lambda c: F.length(bare) - F.length(F.replace(bare, F.lit(c), F.lit("")))
    words = F.size(F.filter(F.split(bare, r"\s+"), lambda w: w != ""))
    return F.when((bare == "") | bare.rlike(r"^(?://|#|/\*)"), 0).otherwise(n("(") * 2 + n("{") * 2 + n("=") + n(".") + words)


def token_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def dense_lines(lines: Column, budget: Column) -> Column:
    """The densest lines, the first of equals first, up to the one that would exceed ``budget`` tokens."""
    scored = F.array_sort(F.transform(lines, lambda x, i: F.struct((-code_density(x)).alias("d"), i.alias("i"), x.alias("x"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(False).alias("full"), F.array().cast("array<string>").alias("kept"))

    def step(acc, x):
        used = acc["used"] + token_estimate(x["x"])
        fits = ~acc["full"] & (used <= budget)
        return F.struct(F.when(fits, used).otherwise(acc["used"]).alias("used"), (~fits).alias("full"), F.when(fits, F.concat(acc["kept"], F.array(x["x"]))).otherwise(acc["kept"]).alias("kept"))

    return F.aggregate(scored, zero, step)["kept"]


def language(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    names = {"go": "go", "py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "rb": "ruby", "rs": "rust", "c": "c", "cpp": "cpp", "sh": "shell", "md": "markdown", "sql": "sql"}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in names.items() for x in p]), ext), F.lit("unknown"))
