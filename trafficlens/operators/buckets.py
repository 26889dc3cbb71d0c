"""Rows to gap-free traffic tables at one or several frequencies.

One pass over the rows counts *cells*: per bucket and country, directory, method
and status code (grouping sets, combined before the shuffle). Everything a table
holds follows from the cells, which are additive, so coarser tables are sums of
finer cells and the rows are never read again.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from trafficlens import fixed_values as V
from trafficlens.functions import times
from trafficlens.functions.sizes import fillable
from trafficlens.operators.quantiles import quantiles_of_counts
from trafficlens.session import lookup, written

# Dimension name and the row column it counts.
DIMENSIONS = {
    "country": "visitor_country",
    "directory": "reqdirectory",
    "method": "reqmethod",
    "response": "response",
}
# Additive measures of a cell and the 0/1 row column they sum.
FLAGS = {
    "n_missing": "bytes_missing",
    "n_dynamic": "is_dynamic",
    "n_commercial": "is_commercial",
    "n_unknown": "is_unknown",
    "n_heavy": "is_heavy",
    "n_image": "is_image",
    "n_get": "is_get",
    "n_post": "is_post",
    "depth": "reqpathdepth",
}
MEASURES = ["n", "size", *FLAGS]


def traffic_cells(rows: DataFrame, minutes: int = 1, keys=("split",), sizes: bool = False) -> DataFrame:
    """Counts and sums per bucket and dimension value.

    With ``sizes`` the same pass also counts rows per status code and size, over
    all rows, for the medians (``dim`` = ``size``, no bucket). Sizes are summed
    as whole bytes, so no sum depends on the order of its rows.
    """
    number = times.bucket_number(F.col("timestamp"), minutes)
    # A typed size is a whole number of bytes over 1000, so this is exact.
    whole = F.round(F.col("bytes") * 1000).cast("decimal(20,0)")
    base = rows.select(
        *keys, number.alias("bucket"), *DIMENSIONS.values(), whole.alias("size"), *FLAGS.values()
    )
    dims = list(DIMENSIONS.values())
    sets = [[*keys, "bucket", d] for d in dims]
    columns = [*keys, "bucket", *dims]
    values = [F.col(d).cast("string") for d in dims]
    kind = F
    for name, d in DIMENSIONS.items():
        if name != "response":
            kind = kind.when(F.grouping(d) == 0, F.lit(name))
    if sizes:
        base = base.withColumn("known", F.col("size"))
        sets.append([*keys, "response", "known"])
        columns.append("known")
        kind = kind.when(F.grouping("known") == 0, F.lit("size"))
        values.append(F.lit(None))
    sums = [F.sum(F.col(column).cast("long")).alias(name) for name, column in FLAGS.items()]
    cells = base.groupingSets(sets, *columns).agg(
        kind.otherwise(F.lit("response")).alias("dim"),
        F.count("*").alias("n"), F.sum("size").cast("decimal(38,0)").alias("size"), *sums,
    )
    extra = [F.col("known")] if sizes else []
    return cells.select(
        *keys, F.lit(minutes).alias("minutes"), "bucket", "dim",
        F.coalesce(*values).alias("value"), "response", *extra, *MEASURES,
    )


def rolled_up(cells: DataFrame, lengths, keys=("split",)) -> DataFrame:
    """One-minute cells as cells of every wanted length, in steps: each length is summed
    from the longest finer one that fits it, so 15 minutes are sums of 5-minute cells.

    The cells are dealt out once, by their longest block of time; all steps stay inside
    the block, so no further shuffle follows however many lengths are wanted.
    """
    lengths = sorted(set(lengths))
    block = F.floor(F.col("bucket") / math.lcm(*lengths)).cast("long").alias("_block")
    names = [*keys, "bucket", "dim", "value", "response", *MEASURES]
    levels = {1: cells.select(*names, block).repartition(*keys, "dim", "value", "_block")}
    for length in lengths:
        if length not in levels:
            finer = max(n for n in levels if length % n == 0)
            bucket = F.floor(F.col("bucket") / (length // finer)).cast("long")
            coarser = levels[finer].withColumn("bucket", bucket)
            levels[length] = _summed(coarser, [*keys, "bucket", "dim", "value", "response", "_block"])
    parts = [levels[length].select(F.lit(length).alias("minutes"), *names) for length in lengths]
    return reduce(lambda a, b: a.unionByName(b), parts)


def _summed(cells: DataFrame, group) -> DataFrame:
    return cells.groupBy(*group).agg(
        *(F.sum(m).cast("decimal(38,0)" if m == "size" else "long").alias(m) for m in MEASURES)
    )


def summed_cells(cells: DataFrame, keys=("split",)) -> DataFrame:
    """Cells of several passes as one cell per bucket and dimension value again; the size
    cells as one per status code and size."""
    sizes = ["known"] if "known" in cells.columns else []
    return _summed(cells, [*keys, "minutes", "bucket", "dim", "value", "response", *sizes])


def medians_of_cells(cells: DataFrame, keys=("split",)) -> DataFrame:
    """Median size per status code from the size cells of a pass."""
    counts = cells.where((F.col("dim") == "size") & F.col("known").isNotNull() & F.col("response").isNotNull())
    counts = counts.select(*keys, "response", (F.col("known").cast("double") / 1000.0).alias("value"), "n")
    return quantiles_of_counts(counts, [*keys, "response"], {"median_bytes": 0.5}).drop("n")


def _of(dim: str, value: Column) -> Column:
    return F.when(F.col("dim") == dim, value)


def bucket_stats(cells: DataFrame, medians: DataFrame, keys=("split",)) -> DataFrame:
    """One row per non-empty bucket.

    The sum of filled sizes is the sum of the known ones plus, per status code,
    missing rows times the code's median. Directories are first counted by their
    number of hits: the entropy needs only how many directories have n hits, and
    a bucket of N rows has at most sqrt(2N) different n, so even a bucket with a
    third of all rows comes together as few rows.
    """
    group = [*keys, "minutes", "bucket"]
    # Cells without a code get codes that no line has, so they spread over tasks.
    spare = -1 - F.pmod(F.xxhash64("value", "bucket"), F.lit(1009)).cast("int")
    filled = (
        cells.withColumn("_code", F.coalesce("response", spare))
        .join(medians.withColumnRenamed("response", "_code"), [*keys, "_code"], "left")
    )
    fill = F.when(fillable(F.col("response")), F.coalesce("median_bytes", F.lit(0.0)))
    filled = filled.withColumns({
        "kilobytes": F.coalesce(F.col("n_missing") * fill, F.lit(0.0)),
        "n_error": F.when(F.col("response") >= 400, F.col("n")),
        "n_server_error": F.when(F.col("response") >= 500, F.col("n")),
        "n_redirection": F.when((F.col("response") >= 300) & (F.col("response") < 400), F.col("n")),
        "n_top": F.when((F.col("dim") == "country") & (F.col("value") != V.OTHER_COUNTRY), F.col("n")),
        "hits": _of("directory", F.col("n")),
    })
    totals = [
        "n", "size", "kilobytes", *FLAGS, "n_error", "n_server_error", "n_redirection",
    ]
    by_hits = filled.groupBy(*group, "dim", "hits").agg(
        F.count("*").alias("values"), F.max("n_top").alias("n_top"),
        *(F.sum(F.col(c)).alias(c) for c in totals),
    )
    # The bucket's rows are needed for each share; the window and the last sum use
    # the same partitioning.
    rows = F.sum(_of("response", F.col("n"))).over(W.partitionBy(*group))
    share = F.col("hits") / F.col("rows")
    bits = F.col("values") * share * F.log2(share + F.lit(V.ENTROPY_EPSILON))
    merged = by_hits.withColumn("rows", rows).groupBy(*group).agg(
        *(F.sum(_of("response", F.col(c))).alias(c) for c in totals),
        *(F.sum(_of(d, F.col("values"))).alias(f"{d}_values") for d in ("country", "directory", "method")),
        F.max("n_top").alias("n_top"), (-F.sum(bits)).alias("entropy"),
    )

    def rate(name: str) -> Column:
        return F.col(name) / F.col("n")

    return merged.select(
        *group,
        F.col("n").alias("y_req"),
        (F.coalesce(F.col("size").cast("double"), F.lit(0.0)) / F.lit(1000.0) + F.col("kilobytes")).alias("y_bytes_imp"),
        rate("n_missing").alias("bytes_missing_rate"),
        (F.col("n_missing") == F.col("n")).cast("byte").alias("bytes_all_missing"),
        F.coalesce(rate("n_error"), F.lit(0.0)).alias("error_rate"),
        F.coalesce(rate("n_server_error"), F.lit(0.0)).alias("server_error_rate"),
        F.coalesce(rate("n_redirection"), F.lit(0.0)).alias("redirection_rate"),
        rate("n_dynamic").alias("dynamic_rate"),
        rate("n_commercial").alias("commercial_rate"),
        rate("n_unknown").alias("unknown_rate"),
        rate("depth").alias("avg_path_depth"),
        F.col("country_values").alias("country_nunique"),
        F.col("directory_values").alias("dir_nunique"),
        F.col("method_values").alias("method_nunique"),
        F.coalesce(rate("n_top"), F.lit(0.0)).alias("top_country_share"),
        F.col("entropy").alias("endpoint_entropy"),
        rate("n_heavy").alias("ratio_heavy"),
        rate("n_image").alias("ratio_image"),
        rate("n_get").alias("ratio_get"),
        rate("n_post").alias("ratio_post"),
    )


# Empty days after which rows count as far from the others: a clock that was wrong, not
# a gap. Ten years are five million one-minute buckets.
MOST_EMPTY_DAYS = 3660


def _days(found: DataFrame, keys, weight: str | None) -> DataFrame:
    """Per series and day: first and last non-empty bucket, rows, and the last bucket of
    the series' day before. A series has no more days than the calendar."""
    group = [*keys, "minutes"]
    days = found.where(F.col("bucket").isNotNull()).groupBy(*group, F.expr("bucket * minutes div 1440").alias("_day")).agg(
        F.min("bucket").alias("_low"), F.max("bucket").alias("_high"),
        (F.sum(weight) if weight else F.count("*")).alias("_rows"))
    before = W.partitionBy(*group).orderBy("_day")
    return days.withColumns({"_day_before": F.lag("_day").over(before), "_before": F.lag("_high").over(before)})


def spans(found: DataFrame, keys=("split",), weight: str | None = None, most_empty_days: int = MOST_EMPTY_DAYS) -> DataFrame:
    """First and last bucket of each series, its rows, and the rows set aside. ``weight``
    names the rows of a bucket; without it each found row counts as one.

    More than ``most_empty_days`` empty days cut a series. The part with the most rows (of
    equal ones the earliest) is the series; the rows of the others lie far from it, as
    those of a line dated 9999 do, and are only counted, so that one wrong clock does not
    ask for billions of empty buckets.
    """
    group = [*keys, "minutes"]
    cut = F.coalesce(F.col("_day") - F.col("_day_before") - 1 > most_empty_days, F.lit(False)).cast("long")
    part = F.sum(cut).over(W.partitionBy(*group).orderBy("_day"))
    parts = _days(found, keys, weight).withColumn("_part", part).groupBy(*group, "_part").agg(
        F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.sum("_rows").alias("_rows"))
    best = F.max_by(F.struct("_low", "_high", "_rows"), F.struct(F.col("_rows"), -F.col("_low")))
    chosen = parts.groupBy(*group).agg(best.alias("_best"), F.sum("_rows").alias("_all"))
    return chosen.select(
        *group, F.col("_best._low").alias("first"), F.col("_best._high").alias("last"),
        F.col("_best._rows").alias("rows"), (F.col("_all") - F.col("_best._rows")).alias("rows_set_aside"))


def gap_runs(found: DataFrame, keys=("split",)) -> DataFrame:
    """The empty buckets between non-empty ones as runs: ``first``, ``last``, ``buckets``.

    No bucket is made for a run, however long. Runs inside a day are found day by day,
    those between days from the first and last buckets of the days.
    """
    group = [*keys, "minutes"]
    inside = W.partitionBy(*group, "_day").orderBy("bucket")
    filled = found.where(F.col("bucket").isNotNull()).select(*group, "bucket").distinct()
    within = filled.withColumn("_day", F.expr("bucket * minutes div 1440")).withColumn(
        "_before", F.lag("bucket").over(inside)).select(*group, "_before", F.col("bucket").alias("_after"))
    between = _days(found, keys, None).select(*group, "_before", F.col("_low").alias("_after"))
    runs = within.unionByName(between).where(F.col("_after") - F.col("_before") > 1)
    return runs.select(
        *group, (F.col("_before") + 1).alias("first"), (F.col("_after") - 1).alias("last"),
        (F.col("_after") - F.col("_before") - 1).alias("buckets"))


def dense_grid(
    found: DataFrame, keys=("split",), block: int = 4096, weight: str | None = None,
    most_empty_days: int = MOST_EMPTY_DAYS, lengths=None,
) -> DataFrame:
    """Every bucket number from the first to the last non-empty one of a series, without
    rows far from the others (see ``spans``). With ``lengths`` the same for buckets of so
    many minutes each, where ``found`` has one-minute buckets.

    The numbers come block by block: the list of blocks is spread over the tasks
    before each block is filled, so no long list is ever built.
    """
    group = [*keys, "minutes"]
    blocks = _blocks(_ends(found, keys, weight, most_empty_days, lengths), block)
    spread = blocks.repartition(*group, "_block")
    return spread.select(*group, F.explode(F.sequence("_low", "_high")).alias("bucket"))


def _ends(found: DataFrame, keys, weight, most_empty_days: int = MOST_EMPTY_DAYS, lengths=None) -> DataFrame:
    """The spans of the series, with ``lengths`` in buckets of so many minutes each."""
    ends = spans(found, keys, weight, most_empty_days)
    if lengths is not None:
        ends = ends.withColumn("minutes", F.explode(F.array(*(F.lit(n) for n in lengths))))
        ends = ends.withColumns({c: F.floor(F.col(c) / F.col("minutes")) for c in ("first", "last")})
    return ends


def _blocks(ends: DataFrame, block: int) -> DataFrame:
    """The blocks of each series by number, with their first and last bucket."""
    number = lambda c: F.floor(F.col(c) / block)
    blocks = ends.withColumn("_block", F.explode(F.sequence(number("first"), number("last"))))
    return blocks.withColumns({
        "_low": F.greatest("first", F.col("_block") * block),
        "_high": F.least("last", F.col("_block") * block + block - 1)})


def gap_free(found: DataFrame, ends: DataFrame, keys=("split",), block: int = 4096) -> DataFrame:
    """``found``, one row per non-empty bucket, and rows with null values for the empty
    buckets from the first to the last one of each series in ``ends``.

    Only found rows and one mark per block move. Behind the shuffle each is followed by the
    empty buckets up to the next one of its block, so the grid itself is never shuffled,
    joined or sorted, however sparse the series are. As in a join, a null key finds nothing.
    """
    group = [*keys, "minutes"]
    values = [c for c in found.columns if c not in (*group, "bucket")]
    known = found.where(reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in group)))
    known = known.select(
        *group, "bucket", F.floor(F.col("bucket") / block).alias("_block"), F.struct(*values).alias("_values"))
    marks = _blocks(ends, block).select(*group, F.col("_low").alias("bucket"), "_block", "_low", "_high")
    rows = known.unionByName(marks, allowMissingColumns=True).repartition(*group, "_block")
    here = W.partitionBy(*group, "_block")
    # The mark stands before a found row of its bucket and then yields nothing.
    after = F.lead("bucket").over(here.orderBy("bucket", F.col("_values").isNotNull()))
    rows = rows.withColumns({"_after": after, "_low": F.max("_low").over(here), "_high": F.max("_high").over(here)})
    last = F.least(F.coalesce(F.col("_after") - 1, F.col("_high")), F.col("_high"))
    rows = rows.where((F.col("bucket") >= F.col("_low")) & (last >= F.col("bucket")))
    rows = rows.select(*group, "bucket", "_values", F.explode(F.sequence("bucket", last)).alias("_at"))
    own = F.when(F.col("_at") == F.col("bucket"), F.col("_values"))
    return rows.select(*group, F.col("_at").alias("bucket"), *(own[c].alias(c) for c in values))


# Columns that are 0 in an empty bucket; the path depth stays null there.
ZERO_WHEN_EMPTY = [
    "y_req", "y_bytes_imp", "bytes_missing_rate", "bytes_all_missing", "error_rate",
    "server_error_rate", "redirection_rate", "dynamic_rate", "commercial_rate",
    "unknown_rate", "country_nunique", "dir_nunique", "method_nunique",
    "top_country_share", "endpoint_entropy", "ratio_heavy", "ratio_image", "ratio_get",
    "ratio_post",
]


def fill_grid(ends: DataFrame, stats: DataFrame, keys=("split",)) -> DataFrame:
    """The gap-free table with its bucket start and calendar columns."""
    group = [*keys, "minutes", "bucket"]
    full = gap_free(stats, ends, keys)
    names = {m: f for f, m in V.FREQ_MINUTES.items()}
    label = F
    for minutes, freq in names.items():
        label = label.when(F.col("minutes") == minutes, F.lit(freq))
    label = label.otherwise(F.concat(F.col("minutes").cast("string"), F.lit("m")))
    kinds = dict(stats.dtypes)
    values = []
    for c in stats.columns:
        if c in ZERO_WHEN_EMPTY:
            values.append(F.coalesce(c, F.lit(0).cast(kinds[c])).alias(c))
        elif c not in group:
            values.append(F.col(c))
    timed = full.select(
        *keys, label.alias("freq"),
        times.bucket_time(F.col("bucket"), F.col("minutes")).alias("timestamp"), *values,
    )
    return timed.withColumns(times.calendar(F.col("timestamp")))


def stored_cells(rows: DataFrame, minutes: int = 1, keys=("split",)) -> DataFrame:
    """The cells of one pass, written below the shared folder: the tables, the
    medians and the grid all read them, and the rows are read only once."""
    return written(traffic_cells(rows, minutes, keys, sizes=True), "cells")


def bucket_table(rows: DataFrame, freq: str, keys=("split",)) -> DataFrame:
    """The traffic table of one frequency."""
    cells = stored_cells(rows, V.FREQ_MINUTES[freq], keys)
    hits = cells.where(F.col("dim") != "size")
    stats = bucket_stats(hits, lookup(medians_of_cells(cells, keys), "medians"), keys)
    return fill_grid(_ends(_one_kind(hits), keys, "n"), stats, keys)


def _one_kind(cells: DataFrame) -> DataFrame:
    """Cells that count each row once."""
    return cells.where(F.col("dim") == "response")


def bucket_tables(rows: DataFrame, freqs=tuple(V.FREQ_MINUTES), keys=("split",)) -> DataFrame:
    """The traffic tables of several frequencies in one frame with a ``freq`` column."""
    return tables_of_cells(stored_cells(rows, 1, keys), freqs, keys)


def tables_of_cells(cells: DataFrame, freqs=tuple(V.FREQ_MINUTES), keys=("split",)) -> DataFrame:
    """The traffic tables from one-minute cells and their size cells."""
    lengths = [V.FREQ_MINUTES[f] for f in freqs]
    hits = cells.where(F.col("dim") != "size")
    stats = bucket_stats(rolled_up(hits, lengths, keys), lookup(medians_of_cells(cells, keys), "medians"), keys)
    return fill_grid(_ends(_one_kind(hits), keys, "n", lengths=lengths), stats, keys)


def add_to_cells(rows: DataFrame, store: str, part: str, keys=("split",)) -> None:
    """Adds new rows, a day of log files say, to a store of one-minute cells. Cells are
    sums, so nothing of the earlier parts is read. A part that is written again replaces
    itself, so a failed run can be repeated."""
    if not re.fullmatch(r"[A-Za-z0-9._-]+", part):
        raise ValueError(f"no name for a part of a store: {part!r}")
    traffic_cells(rows, 1, keys, sizes=True).write.mode("overwrite").parquet(f"{store}/part={part}")


def cells_in(spark: SparkSession, store: str, keys=("split",)) -> DataFrame:
    """All cells of a store, those of several parts added up, stored once for the tables."""
    found = spark.read.option("basePath", store).parquet(f"{store}/part=*").drop("part")
    return written(summed_cells(found, keys), "cells")


def _counted(rows: DataFrame, minutes: int, keys) -> DataFrame:
    number = times.bucket_number(F.col("timestamp"), minutes)
    counts = (
        rows.groupBy(*keys, F.lit(minutes).alias("minutes"), number.alias("bucket"))
        .agg(F.count("*").alias("requests"))
        .where(F.col("bucket").isNotNull())
    )
    return written(counts, "requests")


def requests_per(rows: DataFrame, minutes: int, keys=("split",), most_empty_days: int = MOST_EMPTY_DAYS) -> DataFrame:
    """Requests per bucket of any length, empty buckets as 0."""
    counts = _counted(rows, minutes, keys)
    ends = _ends(counts, keys, "requests", most_empty_days)
    return gap_free(counts, ends, keys).select(
        *keys, times.bucket_time(F.col("bucket"), F.col("minutes")).alias("timestamp"),
        F.coalesce("requests", F.lit(0).cast("long")).alias("requests"),
    )


def _with_times(runs: DataFrame, keys, *rest: str) -> DataFrame:
    at = [times.bucket_time(F.col(c), F.col("minutes")).alias(c) for c in ("first", "last")]
    return runs.select(*keys, *at, *rest)


def series_spans(rows: DataFrame, minutes: int, keys=("split",), most_empty_days: int = MOST_EMPTY_DAYS) -> DataFrame:
    """Report on the grid of each series: first and last bucket start, rows inside, and
    rows set aside because they lie too far from the others."""
    found = spans(_counted(rows, minutes, keys), keys, "requests", most_empty_days)
    return _with_times(found, keys, "rows", "rows_set_aside")


def empty_runs(rows: DataFrame, minutes: int, keys=("split",)) -> DataFrame:
    """Runs of empty buckets: start of the first and the last one, and their number."""
    return _with_times(gap_runs(_counted(rows, minutes, keys), keys), keys, "buckets")
