"""Quality rules from cross-document line frequency, in DataFrame functions only.

Lines are normalised (lower case, one blank for each run of white space, trimmed) and hashed.
For each host the operator counts the distinct documents that hold a line, removes lines above
the limit and rejects documents that lose most of their words.

Copies would make every line of a copied text look like boilerplate, so a document is counted
by a signature (the least hash of its 8-word windows): exact copies, and near copies that share that window,
count once. A line that many documents share could hold the least window of each, so documents are counted
by several hash functions, and the largest count holds. Limits are a share of the host's documents with
a floor, so they act alike at every size.

Edge cases: null or empty text has no words and fails the base rules; a null host is the host
``''``; repeated rows count as one document; a text under 8 words is its own window; a very long text is
one row's arrays of words and lines, held whole by a task; a line at a limit stays, one above it goes.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm._common import checkpointed, let, spread_join

ODD_WHITE = "[ \\t\\x0B\\f\\r]{2,}|[\\t\\x0B\\f\\r]"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 8
#: Hash functions by which documents are counted.
SIGNATURES = 4
MIN_WORDS = 20
REPEAT_PERCENT = 30
#: A line goes when more distinct documents of its host than this floor and this share hold it.
MIN_DOCS = 20
DOC_SHARE = 0.01
#: A document is depleted when more than this share of its words went with such lines.
DEPLETED = 0.5


def _flat(text: Column) -> Column:
    """The text with one blank for each run of white space within a line; line breaks stay."""
    odd = reduce(or_, [F.contains(text, F.lit(x)) for x in ("  ", "\t", "\x0b", "\f", "\r")])
    return F.when(odd, F.regexp_replace(text, ODD_WHITE, " ")).otherwise(text)


def _words(flat: Column) -> Column:
    return F.filter(F.split(F.replace(flat, F.lit("\n"), F.lit(" ")), " "), lambda w: w != "")


def _windows(h: Column) -> Column:
    """Hashes of the 8-word windows, from the words' hashes."""

    def paired(h: Column, step: int) -> Column:
        """Each hash with the one ``step`` places on; the last ``step`` pair with nothing."""
        return F.zip_with(h, F.slice(h, step + 1, F.greatest(F.size(h) - step, F.lit(0))), lambda x, y: F.xxhash64(x, y))

    n = F.size(h) - (WINDOW - 1)
    eight = let(paired(h, 1), lambda two: let(paired(two, 2), lambda four: paired(four, 4)))
    return F.when(n > 0, F.slice(eight, 1, F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _signatures(words: Column) -> Column:
    """Per hash function, the least hash of the windows in lower case."""
    least = lambda w: F.array(*[F.array_min(F.transform(w, lambda x, k=k: F.xxhash64(x, F.lit(k)))) for k in range(SIGNATURES)])
    return let(F.transform(words, lambda w: F.xxhash64(F.lower(w))), lambda h: let(F.when(F.size(h) < WINDOW, F.array(F.xxhash64(h))).otherwise(_windows(h)), least))


def _repeat_words(words: Column) -> Column:
    """Words inside 8-word windows that occur twice or more, the first occurrence included."""

    def covered(s: Column) -> Column:
        """s: windows as (hash, position), sorted."""
        twice = F.transform(s, lambda w, k: F.when(((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == w["h"])) | ((k < F.size(s) - 1) & (s[F.least(k + 1, F.size(s) - 1)]["h"] == w["h"])), w["i"]).otherwise(-1))
        at = F.array_sort(F.filter(twice, lambda i: i >= 0))
        start = F.struct(F.lit(0).alias("c"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(at, start, lambda a, p: F.struct((a["c"] + F.least(F.lit(WINDOW), p - a["last"])).alias("c"), p.alias("last")))["c"]

    def counted(w: Column) -> Column:
        pairs = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), let(pairs, covered)).otherwise(0)

    return let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: let(_windows(h), counted))


def _raw_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))


def _line_hashes(flat: Column) -> Column:
    """The hash of each normalised line, 0 for one without a word."""
    return F.transform(F.split(F.lower(flat), "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))).otherwise(0))


def _normal(flat: Column) -> Column:
    """The normalised lines that hold a word."""
    return F.filter(F.transform(F.split(F.lower(flat), "\n"), lambda x: F.trim(x)), lambda x: x != "")


def _lines(flat: Column) -> Column:
    """(hash, words) of each normalised line that holds a word."""
    return F.transform(_normal(flat), lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n")))


def measures(text: Column) -> Column:
    """A struct of the base counts and of the lines' hashes and words; evaluated once per row."""

    def of(flat: Column, words: Column, raw: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(raw) - F.size(F.array_distinct(raw))).cast("long").alias("n_dup_lines"),
            _repeat_words(words).cast("long").alias("n_repeat_words"),
            _lines(flat).alias("lines"),
            _signatures(words).alias("signs"),
        )

    return let(_flat(text), lambda f: let(_words(f), lambda w: let(_raw_lines(text), lambda x: of(f, w, x))))


def frequent_lines(docs: DataFrame, total: int, min_docs: int = MIN_DOCS, doc_share: float = DOC_SHARE) -> DataFrame:
    """(host, h, rows) of the lines above the limit, with the number of rows that hold them; docs has host, lines and signs, and in all ``total`` lines."""
    most = F.greatest(*[F.count_distinct(F.col("signs")[k]) for k in range(SIGNATURES)])
    signed = docs.filter(F.size("lines") > 0).select("host", "signs", F.array_distinct(F.col("lines.h")).alias("hs"))
    hosts = signed.groupBy("host").agg(most.alias("host_docs"))
    held = signed.select("host", "signs", F.explode("hs").alias("h"))
    # a line above the floor is in more rows than it
    often = checkpointed(held.groupBy("host", "h").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > min_docs))
    seen = spread_join(held, often, ["host", "h"], "rows", "signs", total).groupBy("host", "h", "rows").agg(most.alias("docs"))
    return seen.filter(F.col("docs") > min_docs).join(hosts, "host").filter(F.col("docs") > doc_share * F.col("host_docs")).select("host", "h", "rows")


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: key, base counts, base_failed, n_line_words (words in removed lines), kept, gone (hashes of the removed lines, null for none)."""
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    row = docs.select(F.col(key).alias("key"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), measures(whole).alias("m"))
    # a few numbers a line, read four times below: written once, so that texts are measured once
    row = checkpointed(row.select("key", "host", *[F.col("m")[c].alias(c) for c in (*COUNTS, "lines", "signs")]))
    gone = row.select("key", "host", F.explode("lines").alias("x")).select("key", "host", F.col("x")["h"].alias("h"), F.col("x")["n"].alias("n"))
    total = row.agg(F.sum(F.size("lines"))).first()[0] or 0
    # a line may stand several times in a row, so that its rows in ``gone`` exceed the documents that hold it
    gone = spread_join(gone, checkpointed(frequent_lines(row, total)), ["host", "h"], "rows", "key", total).groupBy("key").agg(F.sum("n").alias("n_line_words"), F.collect_set("h").alias("gone"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    # a null key joins nothing, so its row keeps every line
    out = row.select("key", *COUNTS).join(gone, "key", "left").withColumns({"n_line_words": F.coalesce("n_line_words", F.lit(0)).cast("long"), "base_failed": failed})
    out = out.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(F.col("n_line_words") <= DEPLETED * F.col("n_words")))
    return out.select(F.col("key").alias(key), *COUNTS, "base_failed", "n_line_words", "kept", "gone")


def pipeline_stage(docs: DataFrame) -> DataFrame:
    """The kept documents, without the removed lines; columns as in ``docs``.

    Where two rows share a key, one that is kept keeps both; a null key has no verdict, and its rows stay as they are.
    """
    verdict = quality_rules(docs).filter("kept").groupBy(F.col("doc_id").alias("key")).agg(F.first("gone").alias("gone"))
    # the row in one column, so that no name of docs meets those used here
    held = docs.select(F.col("doc_id").alias("key"), F.struct("*").alias("row")).join(verdict, "key")
    text = F.col("row")["text"]
    lines, hashes = F.split(text, "\n"), _line_hashes(_flat(text))
    left = F.filter(F.arrays_zip(lines.alias("x"), hashes.alias("h")), lambda p: ~F.array_contains(F.col("gone"), p["h"]))
    clean = F.when(F.size("gone") > 0, F.array_join(F.transform(left, lambda p: p["x"]), "\n")).otherwise(text)
    return held.select(F.col("row").withField("text", clean).alias("row")).select("row.*").union(docs.filter("doc_id IS NULL"))
