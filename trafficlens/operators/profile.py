"""Column profiles: counts, shares, top lists, quantile summaries, correlations."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from trafficlens import fixed_values as V
from trafficlens.functions import host as H, times
from trafficlens.operators import enrich
from trafficlens.operators.comoments import moments
from trafficlens.operators.quantiles import exact_quantiles, quantiles_of_counts, value_counts
from trafficlens.session import lookup, written


def counts_by(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per value, nulls left out."""
    known = df
    for c in columns:
        known = known.where(F.col(c).isNotNull())
    return known.groupBy(*columns).agg(F.count("*").alias("count"))


def largest_first(counts: DataFrame) -> DataFrame:
    """Descending, ties by value, for a report."""
    rest = [F.col(c) for c in counts.columns if c != "count"]
    return counts.orderBy(F.desc("count"), *rest)


def top(counts: DataFrame, n: int) -> DataFrame:
    return largest_first(counts).limit(n)


def shares(counts: DataFrame, name: str = "share", keys=()) -> DataFrame:
    """Each count over the sum of all counts, or of those with the same keys (each with
    few values). Store counts that are dear to make: without keys they are read twice."""
    if keys:
        return counts.withColumn(name, F.col("count") / F.sum("count").over(W.partitionBy(*keys)))
    total = counts.agg(F.sum("count")).scalar()
    return counts.withColumn(name, F.col("count") / total)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def top_resources(rows: DataFrame, n: int = V.TOP_RESOURCES) -> DataFrame:
    """Most requested urls that are neither images nor directories."""
    kind = F.col("reqresourcetype")
    return top(counts_by(rows.where((kind != "Image") & (kind != "Directory")), "requrl"), n)


def top_directories(rows: DataFrame, n: int = V.TOP_RESOURCES) -> DataFrame:
    return top(counts_by(rows, "reqdirectory"), n)


def top_countries(rows: DataFrame, column: str = "visitor_country", n: int = V.TOP_COUNTRIES) -> DataFrame:
    return top(counts_by(rows.where(F.col(column) != V.NON_COUNTRY), column), n)


def add_top_country(rows: DataFrame, n: int = V.TOP_COUNTRIES) -> DataFrame:
    """Keep the ``n`` most frequent countries, call the rest one name, flag the kept ones.

    The list has ``n`` rows, so it is broadcast.
    """
    kept = top_countries(rows, n=n).select(F.col("visitor_country").alias("_top"))
    joined = rows.join(F.broadcast(kept), F.col("visitor_country") == F.col("_top"), "left")
    found = F.col("_top").isNotNull()
    return joined.withColumns({
        "visitor_country": F.when(found, F.col("_top")).otherwise(F.lit(V.OTHER_COUNTRY)),
        "is_top_country": found.cast("int"),
    }).drop("_top")


def add_frequency(rows: DataFrame, column: str, name: str) -> DataFrame:
    """Each row's relative frequency of its category."""
    table = lookup(shares(written(counts_by(rows, column), "counts"), name).drop("count"), "shares")
    return rows.join(table, column, "left")


def counts_by_day_hour(rows: DataFrame, ts: str = "timestamp") -> DataFrame:
    return (
        rows.where(F.col(ts).isNotNull())
        .groupBy(F.to_date(ts).alias("date"), F.hour(ts).alias("hour"))
        .agg(F.count("*").alias("req"))
    )


# Columns of a pivoted table at most.
MOST_DATES = 4000


def hour_by_date(counts: DataFrame, dates=None) -> DataFrame:
    """Hours down, dates across. The dates are the columns, so they must be few;
    without a list they are read from the counts."""
    text = counts.withColumn("date", F.date_format("date", "yyyy-MM-dd"))
    if dates is None:
        dates = [r["date"] for r in text.select("date").distinct().orderBy("date").limit(MOST_DATES + 1).collect()]
        if len(dates) > MOST_DATES:
            raise ValueError(f"more than {MOST_DATES} dates do not fit one table; name the wanted ones")
    return text.groupBy("hour").pivot("date", list(dates)).agg(F.sum("req"))


def outlier_fence(df: DataFrame, value: str = "bytes", keys=("split",)) -> DataFrame:
    """Upper fence q3 + 1.5 (q3 - q1) over the positive values, per split."""
    q = exact_quantiles(df.where(F.col(value) > 0), value, {"q1": 0.25, "q3": 0.75}, keys)
    fence = F.col("q3") + F.lit(V.FENCE_FACTOR) * (F.col("q3") - F.col("q1"))
    return q.select(*keys, "q1", "q3", fence.alias("fence"))


def with_fence(df: DataFrame, value: str = "bytes", keys=("split",)) -> DataFrame:
    """Each row with its split's fence."""
    fences = lookup(outlier_fence(df, value, keys).select(*keys, "fence"), "fences")
    return df.join(fences, list(keys), "left")


def summary(df: DataFrame, value: str = "bytes", keys=("split",)) -> DataFrame:
    """Mean, median, mode (the smallest of the most frequent) and maximum.

    All four follow from the value counts; the mode is the largest pair of count
    and negative value, so no group is brought together.
    """
    counts = written(value_counts(df, value, keys), "value-counts")
    middle = quantiles_of_counts(counts, keys, {"median": 0.5}).drop("n")
    best = F.max(F.struct(F.col("n"), (-F.col("value")).alias("low"), F.col("value")))
    rest = counts.groupBy(*keys).agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        best.alias("_best"), F.max("value").alias("max"),
    )
    return rest.join(middle, list(keys)).select(
        *keys, "mean", "median", F.col("_best.value").alias("mode"), "max"
    )


def histogram(df: DataFrame, value: str = "bytes", keys=("split",), bins: int = V.HISTOGRAM_BINS) -> DataFrame:
    """Rows per equal-width bin between the smallest and largest value; the largest
    value belongs to the last bin. Equal values are counted once."""
    counts = written(value_counts(df, value, keys), "value-counts")
    ends = counts.groupBy(*keys).agg(F.min("value").alias("_low"), F.max("value").alias("_high"))
    ends = lookup(ends, "ends")
    width = F.col("_high") - F.col("_low")
    at = F.when(width > 0, F.floor((F.col("value") - F.col("_low")) * bins / width)).otherwise(F.lit(0))
    bin_ = F.least(at, F.lit(bins - 1)).cast("int")
    return counts.join(ends, list(keys)).groupBy(*keys, bin_.alias("bin")).agg(F.sum("n").alias("count"))


def correlations(df: DataFrame, columns) -> DataFrame:
    """Pearson correlation of every pair, over the rows where both are known, in one
    pass; null where a column is constant there."""
    columns, found = list(columns), moments(df, columns)
    table = found.correlation() if found else np.full((len(columns),) * 2, np.nan)
    rows = [(columns[i], columns[j], None if np.isnan(table[i, j]) else float(table[i, j]))
            for i, j in combinations(range(len(columns)), 2)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, corr double")


def correlation_rows(rows: DataFrame, keys=("split",)) -> DataFrame:
    """The columns of the row correlations, from enriched rows. What they need of a row
    is stored once; its medians, frequencies and top countries are read from there."""
    narrow = written(rows.select(
        *keys, "response", "bytes", "reqpathdepth", "requrllength", "is_commercial", "is_dynamic",
        *(c.alias(n) for n, c in times.calendar(F.col("timestamp")).items() if n in ("hour", "is_weekend")),
        H.visitor_type(F.col("visitor_category")).alias("visitor_type"),
        H.visitor_country(F.col("visitor_category"), F.col("tld"), V.NON_COUNTRY).alias("visitor_country")), "narrow-rows")
    full = add_top_country(enrich.add_bytes_imputed(narrow, keys))
    return add_frequency(add_frequency(full, "visitor_country", "country_freq"), "visitor_type", "visitor_type_freq")


def box_summary(df: DataFrame, category: str, value: str) -> DataFrame:
    """Quartiles and whiskers per category. A whisker is the outermost value within
    1.5 quartile distances of the box."""
    counts = written(value_counts(df, value, [category]), "value-counts")
    probs = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    boxes = lookup(quantiles_of_counts(counts, [category], probs), "boxes")
    reach = F.lit(V.FENCE_FACTOR) * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    ends = (
        counts.join(boxes, category).where(inside).groupBy(category)
        .agg(F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"))
    )
    return boxes.join(ends, category).select(
        F.col(category).cast("string").alias("category"),
        "n", "q1", "median", "q3", "whisker_low", "whisker_high",
    )


def _per_column(df: DataFrame, columns, measure, name: str) -> DataFrame:
    one = df.agg(*(measure(F.col(c)).alias(f"m{i}") for i, c in enumerate(columns)))
    items = F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias(name)) for i, c in enumerate(columns)
    ))
    return one.select(F.inline(items))


def null_counts(df: DataFrame, columns=None) -> DataFrame:
    return _per_column(df, columns or df.columns, lambda c: F.count_if(c.isNull()), "nulls")


def distinct_counts(df: DataFrame, columns=None) -> DataFrame:
    """Distinct values per column: each value is kept once per column before it is
    counted, so no column's values meet in one task."""
    columns = list(columns or df.columns)
    pairs = df.select(F.inline(F.array(*(
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ))))
    seen = pairs.groupBy("column", "value").agg(F.lit(1).alias("_one"))
    return seen.groupBy("column").agg(F.count("value").alias("distinct_values"))


def trend(df: DataFrame, x: str, y: str) -> DataFrame:
    """Least-squares line of y over x."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.agg(
        F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"),
        F.count("*").alias("n"),
    )


def fixed_sample(df: DataFrame, key: str, n: int = V.SAMPLE_ROWS, seed: int = V.SAMPLE_SEED) -> DataFrame:
    """A repeatable random sample of n rows: those with the smallest key hashes.

    The hash prefixes are counted first; they show how far the n smallest hashes
    reach, so the final ordering sees little more than n rows of any table.
    """
    mark = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary"))
    marked = df.withColumn("_mark", mark)
    prefix = F.substring("_mark", 1, 5)  # about a million prefixes
    counts = marked.groupBy(prefix.alias("_prefix")).agg(F.count("*").alias("_n"))
    # First by two digits, then by five within the one that n falls into, so that
    # the running totals cover 256 and 4096 rows.
    counts = written(counts, "sample")
    coarse = counts.groupBy(F.substring("_prefix", 1, 2).alias("_head")).agg(F.sum("_n").alias("_n"))
    head, before = "", 0
    for row in coarse.orderBy("_head").collect():
        if before + row["_n"] >= n:
            head = row["_head"]
            break
        before += row["_n"]
    if not head:
        return df
    fine = counts.where(F.col("_prefix").startswith(head)).orderBy("_prefix").collect()
    limit = head
    for row in fine:
        before += row["_n"]
        limit = row["_prefix"]
        if before >= n:
            break
    near = marked.where(prefix <= limit)
    return near.orderBy("_mark", key).limit(n).drop("_mark")
