"""Mixing of sources to target weights by temperature, realised as budgeted block permutations.

With p the sources' token shares, weights are p^a / sum(p^a). The exponent a is bisected between 0 (all alike) and 1
(as they are): the largest a whose entropy meets the target, or a larger one where the smallest source would otherwise
be repeated more often than the limit allows. A source's quota is its weight times the token budget: as many whole
passes over its documents as fit, each pass in an order of its own, and the first documents of one pass more. The
output is dealt into blocks of about equal budgets; each block holds every source at its weight, in an order that
mixes them. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitrine.llm.storage import free_name, stored

#: Target entropy: so far from the sources' own entropy (0) to that of equal weights (1).
ENTROPY_GAIN = 0.5
MAX_REPEATS = 4.0
BLOCK_TOKENS = 1 << 16
#: The exponent is a multiple of 2 ** -LEVELS; a job settles ROUND_LEVELS of them.
LEVELS, ROUND_LEVELS = 20, 5
SEED = "mix-1"
#: Sources that are broadcast at most; more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def source_of() -> Column:
    return F.coalesce(F.col("source").cast("string"), F.lit(""))


def tokens_of() -> Column:
    """Words of the whole text and an end token; a null text has the end token only."""
    return (F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")) + 1).cast("long")


def order_key(copy: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), copy.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def exponent(sources: DataFrame, total: int, gain: float, max_repeats: float, budget_ratio: float) -> float:
    """sources: src, tokens. Settled by bisection, several levels of the halving at a time."""
    share = (F.col("tokens") / F.lit(float(total))).alias("p")
    p = sources.select(share)

    def measure(points: list[int]) -> dict[int, tuple[float, float]]:
        """Entropy and most repeats for each exponent, a multiple of 2 ** -LEVELS."""
        at = p.withColumn("k", F.explode(F.array(*[F.lit(k) for k in points]))).withColumn("a", F.col("k") / F.lit(float(1 << LEVELS)))
        power = F.pow("p", F.col("a"))
        rows = at.groupBy("k", "a").agg(F.sum(power).alias("z"), F.sum(power * F.log("p")).alias("l"), F.max(power / F.col("p")).alias("m"))
        found = rows.select("k", (F.log("z") - F.col("a") * F.col("l") / F.col("z")).alias("h"), (F.col("m") / F.col("z") * budget_ratio).alias("r"))
        return {r["k"]: (r["h"], r["r"]) for r in found.collect()}

    ends = measure([0, 1 << LEVELS])
    target = ends[1 << LEVELS][0] + gain * (ends[0][0] - ends[1 << LEVELS][0])

    def bisect(good) -> int:
        """The last k for which good holds, where it holds up to a point; 0 if nowhere."""
        low, width = 0, 1 << LEVELS
        if good(*ends[1 << LEVELS]):
            return 1 << LEVELS
        while width > 1:
            step = max(1, width >> ROUND_LEVELS)
            seen = measure([low + step * i for i in range(1, width // step)])
            low = max([low, *(k for k, v in seen.items() if good(*v))])
            width = step
        return low

    by_entropy = bisect(lambda h, r: h >= target)
    # Repeats fall as the exponent grows: the first that meets the limit, 1 if none does.
    by_repeats = 0 if ends[0][1] <= max_repeats else min(1 << LEVELS, bisect(lambda h, r: r > max_repeats) + 1)
    return max(by_entropy, by_repeats) / (1 << LEVELS)


def plan(docs: DataFrame, gain: float = ENTROPY_GAIN, max_repeats: float = MAX_REPEATS, budget_ratio: float = 1.0, block_tokens: int = BLOCK_TOKENS) -> tuple[DataFrame, DataFrame]:
    """(rows, sources). rows: doc_id, source, copy, n_tokens, block, slot for every document and copy that is taken;
    sources: src, tokens, quota, passes, rest, cut (the last order key of the pass that is not whole).

    The token budget is budget_ratio times all tokens. A null source is the source ''. Rows with one doc_id in a
    source, null among them, are taken together, in any order of theirs. Other columns are left alone; an empty table gives an empty result.
    """
    table = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_of().alias("src"), tokens_of().alias("n_tokens")), "tokens")
    totals = stored(table.groupBy("src").agg(F.sum("n_tokens").alias("tokens")), "sources")
    total, n_sources = totals.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    a = exponent(totals, total, gain, max_repeats, budget_ratio) if total else 1.0
    power = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(a))
    norm = totals.agg(F.sum(power)).first()[0] or 1.0
    budget = int(total * budget_ratio)
    quota = totals.withColumn("quota", F.floor(power / F.lit(norm) * F.lit(float(budget))).cast("long"))
    quota = quota.withColumn("passes", F.expr("cast(quota div tokens as int)")).withColumn("rest", F.expr("quota % tokens"))
    few = n_sources <= BROADCAST_SOURCES
    quota = F.broadcast(quota) if few else quota
    # Places in each pass: sums over parts of the order first, then within a part. No source is sorted in one task.
    every = table.join(quota, "src").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    every = every.withColumn("key", order_key(F.col("copy"))).withColumn("part", F.substring("key", 1, 3))
    # Rows with one key, those of a source with one doc_id, are summed before the shuffle and go together.
    keys = every.groupBy("src", "tokens", "quota", "passes", "rest", "copy", "part", "key").agg(F.sum("n_tokens").alias("key_tokens"))
    parts = keys.groupBy("src", "copy", "part").agg(F.sum("key_tokens").alias("part_tokens"))
    ahead = Window.partitionBy("src", "copy").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("src", "copy", "part", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("before"))
    inside = Window.partitionBy("src", "copy", "part").orderBy("key")
    placed = keys.withColumn("inside", F.sum("key_tokens").over(inside)).join(parts, ["src", "copy", "part"])
    placed = placed.withColumn("upto", F.col("before") + F.col("inside")).where("copy < passes or upto <= rest")
    blocks = max(1, round(budget / block_tokens))
    big = "decimal(19,0)"
    # Rows that share a key are strewn over its stretch, so that no block takes them all; one alone is at its begin.
    place = F.expr(f"cast(copy as {big}) * tokens + upto - key_tokens + cast(floor((key_tokens - n_tokens) * part_of_one) as bigint)")
    strewn = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20)) / F.lit(float(1 << 20))
    block = F.expr(f"least(cast(cast(place as {big}) * cast({blocks} as {big}) div greatest(quota, 1) as bigint), {blocks - 1}L)")
    rows = every.select("doc_id", "src", "copy", "key", "n_tokens", strewn.alias("part_of_one"))
    rows = rows.join(placed.select("src", "copy", "key", "tokens", "quota", "key_tokens", "upto"), ["src", "copy", "key"])
    out = rows.withColumn("place", place.cast(big)).withColumn("block", block)
    slot = F.row_number().over(Window.partitionBy("block").orderBy("key", "src", "doc_id"))
    rows = out.select("doc_id", F.col("src").alias("source"), "copy", "n_tokens", "block", (slot - 1).alias("slot"))
    cuts = placed.where("copy = passes").groupBy("src").agg(F.max("key").alias("cut"))
    return rows, quota.join(cuts, "src", "left").select("src", "tokens", "quota", "passes", "rest", "cut")


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, copy, n_tokens, block, slot of every document and copy that the mix takes."""
    return plan(docs)[0]


def mixed(docs: DataFrame, gain: float = ENTROPY_GAIN, max_repeats: float = MAX_REPEATS, budget_ratio: float = 1.0) -> DataFrame:
    """The documents of the mix, as often as it takes them; columns as before, whatever their names. Texts stay where they
    are: the sources' passes and cuts, a row for each source, go to the documents.

    A null source is the source ''; a null or empty text counts its end token; rows with one doc_id in a source, null
    among them, are taken together; a long text is one document as any other; an empty table gives an empty result.
    """
    sources = stored(plan(docs, gain, max_repeats, budget_ratio)[1], "mix")
    few = sources.count() <= BROADCAST_SOURCES
    src, passes, cut, copy = (free_name(c, docs.columns) for c in ("src", "passes", "cut", "copy"))
    sources = sources.select(F.col("src").alias(src), F.col("passes").alias(passes), F.col("cut").alias(cut))
    wide = docs.join(F.broadcast(sources) if few else sources, source_of() == F.col(src))
    more = F.coalesce(order_key(F.col(passes)) <= F.col(cut), F.lit(False)).cast("int")
    return wide.withColumn(copy, F.explode(F.array_repeat(F.lit(1), F.col(passes) + more))).select(*docs.columns)
