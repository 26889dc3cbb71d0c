"""Quantiles of groups of any size: exact, or from mergeable sketches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from trafficlens.session import lookup, written

# First bins per doubling; they follow the order of the values.
BINS_PER_DOUBLING = 64
# Parts that a bin with too many distinct values is cut into.
PIECES = 1024
# Distinct values that are put in order at once.
MOST_VALUES = 4096
# Items a sketch keeps: ranks are within about 1.7 % at 200, half of that at twice as many.
SKETCH_ITEMS = 200


def _step(value: Column) -> Column:
    """Number of the first bin, in the order of the values."""
    def steps(v):
        doublings = F.least(F.log2(v), F.lit(1100.0))
        return F.floor(doublings * BINS_PER_DOUBLING).cast("int") + F.lit(100_000)

    return F.when(value > 0, steps(value)).when(value < 0, -steps(-value)).otherwise(F.lit(0))


def value_counts(df: DataFrame, value: str, keys=(), weight: str | None = None) -> DataFrame:
    """Rows per key and value; counted before the shuffle, so equal values travel once."""
    known = df.where(F.col(value).isNotNull())
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    n = F.count("*") if weight is None else F.sum(weight)
    return known.groupBy(*keys, F.col(value).cast("double").alias("value")).agg(n.alias("n"))


def _wanted_ranks(total: Column, probs) -> Column:
    """The two ranks that each quantile lies between, numbered."""
    slots = []
    for i, p in enumerate(probs):
        place = (total - 1) * F.lit(float(p))
        slots.append(F.struct(F.lit(2 * i).alias("slot"), F.floor(place).alias("rank")))
        slots.append(F.struct(F.lit(2 * i + 1).alias("slot"), F.ceil(place).alias("rank")))
    return F.array(*slots)


def _inside(ranks: Column, low: Column, high: Column) -> Column:
    return F.filter(ranks, lambda s: (s["rank"] >= low) & (s["rank"] < high))


def _path() -> Column:
    return F.concat_ws("/", "_bin", "_step").alias("_bin")


def _holding(values: DataFrame, parents: DataFrame | None, keys, probs) -> DataFrame:
    """The bins that hold wanted ranks, with the rows below them, their distinct values
    and their ends. At most two bins per key and quantile, so the table is small."""
    bins = values.groupBy(*keys, "_bin", "_step").agg(
        F.sum("n").alias("_n"), F.count("*").alias("_values"),
        F.min("value").alias("_low"), F.max("value").alias("_high"),
    )
    if parents is None:
        total = F.sum("_n").over(W.partitionBy(*keys))
        bins = bins.withColumns({"_total": total, "_start": F.lit(0).cast("long")})
        bins = bins.withColumn("_ranks", _wanted_ranks(F.col("_total"), probs))
    else:
        bins = bins.join(
            parents.select(*keys, "_bin", "_total", F.col("_below").alias("_start"), "_ranks"), [*keys, "_bin"])
    upto = F.col("_start") + F.sum("_n").over(W.partitionBy(*keys, "_bin").orderBy("_step"))
    placed = bins.withColumn("_upto", upto).withColumn("_below", F.col("_upto") - F.col("_n"))
    return placed.select(
        *keys, _path(), "_below", "_total", "_values", "_low", "_high",
        _inside(F.col("_ranks"), F.col("_below"), F.col("_upto")).alias("_ranks"),
    ).where(F.size("_ranks") > 0)


def quantiles_of_counts(
    counts: DataFrame, keys, probs: dict[str, float], most: int = MOST_VALUES, pieces: int = PIECES
) -> DataFrame:
    """Linear-interpolated exact quantiles from ``keys, value, n``.

    A group is never brought together. Its value counts are summed into bins that follow
    the value order; a running total over these few bins shows which bin holds each wanted
    rank. Such a bin is walked in order if it has ``most`` distinct values or fewer.
    Otherwise it is cut evenly between its smallest and its largest value, and the search
    goes on in the part that holds the rank: every round narrows a bin by ``pieces``, and
    doubles have 52 bits, so a handful of rounds ends it even where every row of a hot
    group has its own value and all lie next to each other.
    """
    keys = list(keys)
    if not keys:
        whole = counts.withColumn("_all", F.lit(0))
        return quantiles_of_counts(whole, ["_all"], probs, most, pieces).drop("_all")
    place = [*keys, "_bin"]
    values = counts.select(*keys, "value", "n", F.lit("").alias("_bin"), _step(F.col("value")).alias("_step"))
    parents, walked = None, []
    while True:
        # Written: the ends are read by the next round, and its size decides how to join.
        held = lookup(_holding(values, parents, keys, probs.values()), "quantile-bins")
        found = values.select(*keys, "value", "n", _path()).join(held, place)
        upto = F.col("_below") + F.sum("n").over(W.partitionBy(*place).orderBy("value"))
        walked.append(
            found.where(F.col("_values") <= most).withColumn("_upto", upto).select(
                *keys, "value", "_total",
                F.explode(_inside(F.col("_ranks"), F.col("_upto") - F.col("n"), F.col("_upto"))).alias("_slot"))
        )
        parents = held.where(F.col("_values") > most)
        if parents.isEmpty():
            break
        width = F.col("_high") - F.col("_low")
        piece = F.floor((F.col("value") - F.col("_low")) / width * pieces).cast("int")
        values = written(
            found.where(F.col("_values") > most).select(*place, "value", "n", piece.alias("_step")), "quantile-values")
    picks = [F.max("_total").alias("_total")]
    for i in range(2 * len(probs)):
        picks.append(F.max(F.when(F.col("_slot.slot") == i, F.col("value"))).alias(f"_v{i}"))
    out = []
    for i, (name, p) in enumerate(probs.items()):
        rank = (F.col("_total") - 1) * F.lit(float(p))
        low, high = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}")
        between = low + (high - low) * (rank - F.floor(rank))
        out.append(F.when(low < high, between).otherwise(low).alias(name))
    hits = reduce(lambda a, b: a.union(b), walked)
    return hits.groupBy(*keys).agg(*picks).select(*keys, F.col("_total").alias("n"), *out)


def exact_quantiles(
    df: DataFrame, value: str, probs: dict[str, float], keys=(), weight: str | None = None
) -> DataFrame:
    """``keys``, the row count ``n`` and one column per named quantile. Nulls in the
    value or a key are left out. The value counts are written, so ``df`` is read once."""
    counts = written(value_counts(df, value, keys, weight), "value-counts")
    return quantiles_of_counts(counts, keys, probs)


# --- sketches -----------------------------------------------------------------


def quantile_sketches(df: DataFrame, value: str, keys=(), items: int = SKETCH_ITEMS) -> DataFrame:
    """One small sketch of the values per key (``keys, sketch``), for values that are too
    many to count: a few kilobytes, made before the shuffle. Nulls are left out."""
    known = df.where(F.col(value).isNotNull())
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    return known.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), items).alias("sketch"))


def merged_sketches(sketches: DataFrame, keys=(), items: int = SKETCH_ITEMS) -> DataFrame:
    """Sketches of several parts (days, files) as one per key; no value is read again."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch", items).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, probs: dict[str, float], keys=()) -> DataFrame:
    """``keys``, ``n`` and the named quantiles as the sketches have them: a value whose
    rank is near the wanted one, without interpolation."""
    return sketches.select(
        *keys, F.kll_sketch_get_n_double("sketch").alias("n"),
        *(F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(name) for name, p in probs.items()))
