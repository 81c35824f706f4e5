"""Mixes sources to target weights by weighted sampling without replacement (Efraimidis and Spirakis).

Sources share a budget of words by weight; a source's target stops at a multiple of its size and the
excess is shared again among the others. A target's complete epochs take every document; what remains is
taken in the order of exponential keys, -ln(u) / weight, until the words of the documents before, summed in that order,
reach it; the document at the boundary is cut there, so that a source's taken words are its target to a word.

u is a digest of the seed and the document, so reruns agree. Nothing is sorted as a whole: the key, as a
whole number of 48 bits (its logarithm), is summed by its upper 12 bits for each source; the digit in which the
budget ends is resolved by the next 12 bits and so on, so a window never holds more than 4,096
rows. Each document is then below, above or at its source's boundary.

Edge cases: null text or one without words has size 0 and nothing is taken; a null source is a source, the last one;
a null key is a document; documents of one key at the boundary stand in order of key and size, and equal ones
share as if they stood one after another; sources without words have target 0; an empty table gives no rows.
The sources, a row each, are ordered in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm._common import checkpointed, spread_join

#: Weights of the sources in order, repeating; the budget as a share of all words, in percent; epochs at most.
WEIGHTS = (5, 2, 1)
PERCENT = 150
EPOCHS = 2
SEED = "mix"
#: Digits and symbols, which count against a text's quality.
BAD = "0123456789#*$%&|<>{}[]\\/_=+~^@"
#: The key: log2 of the exponential between -64 and 64, in 2^41 steps each.
_BITS, _DIGIT, _STEPS = 48, 12, float(1 << 41)
_COPIES = 10000


def words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long")


def quality(text: Column) -> Column:
    """A weight from 0.1 to 1: by the share of characters, white space aside, that are neither digits nor symbols."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    held = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    return F.lit(0.1) + F.when(held > 0, 0.9 * (F.length(F.translate(text, " \t\n\x0b\f\r" + BAD, "")) / held)).otherwise(0.0)


def _key(seed: str, key: Column, size: Column, weight: Column) -> Column:
    """The document's exponential key as a whole number of 48 bits."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("-")), size.cast("string"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)
    return F.least(F.greatest(F.floor((F.log2(-F.ln(u) / weight) + 64.0) * _STEPS), F.lit(0)), F.lit((1 << _BITS) - 1)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """sizes (src, total, rows) with target and weight; src sorts as the sources do, null last.

    With a level l, a source takes the lesser of its limit and l times its weight. By falling need a source
    is full while the budget covers the level at which it is filled; the others share what the full ones leave.
    """
    order = Window.orderBy("src")
    place = (F.row_number().over(order) - 1) % len(weights)
    known = sizes.withColumn("weight", F.array(*[F.lit(w) for w in weights])[place].cast("long")).withColumn("limit", epochs * F.col("total"))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    fill = Window.orderBy(F.col("limit") / F.col("weight"), "src")
    before, whole = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    known = known.withColumns({
        "full_before": F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        "budget": F.sum("total").over(whole),
    })
    is_full = 100 * (big("full_before") * big("weight") + big("open") * big("limit")) <= percent * big("budget") * big("weight")
    known = known.withColumn("full", is_full)
    left = F.lit(percent / 100) * F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(whole), F.lit(0))
    level = left / F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("limit").cast("double")).otherwise(level * F.col("weight"))
    return known.select("src", "total", "rows", "weight", target.alias("target"))


def _boundaries(sized: DataFrame, wanted: DataFrame) -> DataFrame:
    """(src, edge, used) per source with words to take beyond its epochs: the key at which they end and the words before it."""
    at = wanted.filter(F.col("rest") > 0).select("src", "rest", F.lit(0).cast("long").alias("used"))
    for shift in range(_BITS - _DIGIT, -1, -_DIGIT):
        rows = sized.select("src", F.shiftright("k", shift + _DIGIT).alias("prefix"), F.shiftright("k", shift).alias("digit"), "size")
        if "prefix" in at.columns:
            sums = rows.join(at, ["src", "prefix"]).groupBy("src", "rest", "used", "digit").agg(F.sum("size").alias("size"))
        else:
            # every row counts: summed before its source's row joins, so that a source isn't gathered
            sums = rows.groupBy("src", "digit").agg(F.sum("size").alias("size")).join(at, "src")
        w = Window.partitionBy("src").orderBy("digit").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("after", F.col("used") + F.sum("size").over(w))
        crossed = (F.col("after") >= F.col("rest")) & (F.col("after") - F.col("size") < F.col("rest"))
        at = checkpointed(sums.filter(crossed).select("src", "rest", F.col("digit").alias("prefix"), (F.col("after") - F.col("size")).alias("used")))
    return at.select("src", F.col("prefix").alias("edge"), "used")


def _shared(rows: DataFrame) -> DataFrame:
    """The documents at their source's boundary with ``part``, the words taken of each beyond the epochs.

    Equal documents are one row with a count: the first of them are taken whole, one is cut, the others aren't taken.
    """
    items = rows.groupBy("src", "key", "size", "source_size", "target", "epochs", "left").agg(F.count(F.lit(1)).alias("c"))
    before = F.coalesce(F.sum(F.col("c") * F.col("size")).over(Window.partitionBy("src").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    items = items.withColumn("left", F.greatest(F.col("left") - before, F.lit(0))).withColumn("whole", F.least(F.expr("left div size"), F.col("c")))
    left, whole = F.col("left"), F.col("whole")
    cut = F.when(whole < F.col("c"), 1).otherwise(0)
    share = lambda part, n: F.struct(part.cast("long").alias("part"), n.cast("long").alias("n"))
    parts = F.array(share(F.col("size"), whole), share(left - whole * F.col("size"), cut), share(F.lit(0), F.col("c") - whole - cut))
    items = items.select("*", F.explode(F.filter(parts, lambda p: p["n"] > 0)).alias("p"))
    # many equal documents: their rows are made by several tasks
    items = items.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p")["n"] - 1, F.lit(_COPIES).cast("long")))).repartition("src", "key", "chunk")
    last = F.least(F.col("chunk") + _COPIES, F.col("p")["n"]) - 1
    return items.withColumn("copy", F.explode(F.sequence(F.col("chunk"), last))).select("src", "key", "size", "source_size", "target", "epochs", F.col("p")["part"].alias("part"))


def mix(docs: DataFrame, weight: Column | None = None, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """One row per row of docs: key, source, size, source_size, target, taken (words the mix takes, repeats counted)."""
    src = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("~"))
    sized = docs.select(F.col(key).alias("key"), src.alias("src"), words(F.col(text)).alias("size"), (quality(F.col(text)) if weight is None else weight).alias("w"))
    sized = checkpointed(sized.select("key", "src", "size", _key(seed, F.col("key"), F.col("size"), F.col("w")).alias("k")))
    sizes = checkpointed(sized.groupBy("src").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("rows")))
    wanted = targets(sizes, weights, percent, epochs)
    full = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0).cast("long")
    wanted = wanted.select("src", "rows", F.col("total").alias("source_size"), "target", full.alias("epochs"))
    wanted = checkpointed(wanted.withColumn("rest", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long")))
    wanted = checkpointed(wanted.join(_boundaries(sized, wanted), "src", "left"))
    rows = spread_join(sized, wanted, ["src"], "rows", "k", sizes.agg(F.sum("rows")).first()[0] or 0)
    rows = rows.withColumn("left", F.col("rest") - F.col("used"))
    at = (F.col("size") > 0) & F.col("edge").isNotNull() & (F.col("k") == F.col("edge"))
    part = F.when(F.col("k") < F.col("edge"), F.col("size")).otherwise(0).cast("long")
    inner = rows.filter(~at | F.col("edge").isNull()).select("src", "key", "size", "source_size", "target", "epochs", part.alias("part"))
    out = inner.union(_shared(rows.filter(at)))
    name = F.when(F.col("src") != "~", F.substring("src", 2, 1 << 30))
    return out.select(F.col("key").alias(key), name.alias(source), "size", "source_size", "target", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed_texts(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The mix itself: docs, whose key is unique, with ``epoch`` from 1, repeated as taken; the last copy of a cut document is its first words, a blank between them."""
    held = docs.select(F.col(key).alias("_key"), F.struct("*").alias("row")).join(mixed.filter("taken > 0").select(F.col(key).alias("_key"), "size", "taken"), "_key")
    held = held.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("taken") / F.col("size")).cast("long"))))
    n, body = F.least("size", F.col("taken") - (F.col("epoch") - 1) * F.col("size")), F.col("row")[text]
    cut = F.array_join(F.slice(F.filter(F.split(body, "[ \\t-\\r]+"), lambda w: w != ""), F.lit(1), n.cast("int")), " ")
    return held.select(F.col("row").withField(text, F.when(n < F.col("size"), cut).otherwise(body)).alias("row"), "epoch").select("row.*", "epoch")


def brute_force(rows: list[tuple], weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, epochs: int = EPOCHS, seed: str = SEED) -> list[tuple]:
    """(key, size, source_size, target, taken) of (key, source, text) by sharing, sorting and summing plainly; for tests."""
    import hashlib
    import math
    import re
    from collections import defaultdict

    held = defaultdict(list)
    for key, source, text in rows:
        text = text or ""
        dense = re.sub(r"[\x20\x09-\x0D]", "", text)
        w = 0.1 + (0.9 * (sum(c not in BAD for c in dense) / len(dense)) if dense else 0.0)
        size = len(re.findall(r"[^\x20\x09-\x0D]+", text))
        u = (int(hashlib.md5(f"{seed}:{'-' if key is None else key}:{size}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        held[source].append((math.floor((math.log2(-math.log(u) / w) + 64) * _STEPS), key is not None, key or 0, size, key))
    names = sorted(held, key=lambda s: (s is None, s or ""))
    total = {s: sum(x[3] for x in held[s]) for s in names}
    weight, full = {s: weights[i % len(weights)] for i, s in enumerate(names)}, set()
    while True:
        left = percent / 100 * sum(total.values()) - sum(epochs * total[s] for s in full)
        shares = sum(weight[s] for s in names if s not in full)
        target = {s: float(epochs * total[s]) if s in full else left / shares * weight[s] for s in names}
        more = {s for s in names if s not in full and target[s] >= epochs * total[s]}
        if not more:
            break
        full |= more
    out = []
    for s in names:
        whole = int(target[s] // total[s]) if total[s] else 0
        rest = math.floor(target[s] - whole * total[s] + 0.5)
        for _, _, _, size, key in sorted(held[s]):
            part = min(size, max(rest, 0))
            rest -= part
            out.append((key, size, total[s], target[s], whole * size + part))
    return out
