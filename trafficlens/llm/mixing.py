"""Mixing sources to target weights by systematic sampling.

Every document of a source is expected ``target / source size`` times. The expected
copies are added up inside the source, from its shortest document to its longest, one
offset per source is added, and a document is emitted once for each integer boundary
that its share crosses. Ordering by size spreads the extra copies over all sizes, so
that the words taken come near the target and not only the documents.

The sum is never made in one task: all documents of a source have the same share, so
the sum is the share times the document's place, and the place is the number of
documents in earlier blocks plus the place inside the block. A block is one source, one
size and one of ``SPREAD`` hash values; only counts are added up in order: those of the
distinct sizes of a source, and those of the blocks of one size.

Nulls and odd cases: a null text has size 0; a null source is a source of its own, last
in the order; rows that are alike in all columns are separate documents; documents
without words are emitted like others and take nothing; without any word no source has
a share and nothing is emitted; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from trafficlens.llm.tables import n_words, text_of
from trafficlens.session import written

#: Weights of the sources by code point, repeating.
WEIGHTS = (5, 2, 1)
#: A source is taken at most so many times.
MOST = 3.0
#: Blocks of one source and size; a hot source of equal sizes is split into so many.
SPREAD = 64

def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, size, ...) per block to (source, source_size, target), one row a source.

    Sources that would pass ``most`` times their size stop there; the others share what
    is left by weight. That ends where every source has the smaller of its limit and
    one common factor times its weight: sources are taken in the order of limit over
    weight, and the factor is the first that the next source can bear. The windows run
    over one row per source, not over documents.
    """
    table = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    values = F.array(*[F.lit(float(w)) for w in weights])
    table = table.withColumn(
        "weight", F.element_at(values, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    table = table.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    whole = Window.partitionBy()
    table = table.withColumn("__all", F.sum("source_size").over(whole).cast("double"))
    table = table.withColumn("__weights", F.sum("weight").over(whole))
    before = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(
        Window.unboundedPreceding, -1)
    rest = F.col("__all") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    left = F.col("__weights") - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    # The factor if all earlier sources are at their limit. The right one is that of the
    # first source whose own limit it does not pass; later ones are smaller.
    table = table.withColumn("__factor", rest / left)
    fits = F.col("__factor") * F.col("weight") <= F.col("limit")
    table = table.withColumn("__common", F.max(F.when(fits, F.col("__factor"))).over(whole))
    target = F.least(F.col("limit"), F.coalesce(F.col("__common") * F.col("weight"), F.col("limit")))
    return table.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: str = "0") -> Column:
    """A number from 0 to 1, fixed by the source and the seed."""
    digest = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(2**32))


def _placed(docs: DataFrame, weights: tuple[int, ...], most: float, seed: str) -> DataFrame:
    """All columns of the documents and __size, __source_size, __target and __copies."""
    digest = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("text")))
    rows = docs.withColumns({"__size": n_words(text_of()), "__digest": digest})
    rows = rows.withColumn("__block", F.pmod(F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int"), F.lit(SPREAD)))
    # A null source as two plain columns: the window and the join below have the same keys
    # then, and the texts are shuffled once for both.
    rows = rows.withColumns({"__named": F.coalesce(F.col("source"), F.lit("")), "__nameless": F.col("source").isNull()})
    counts = rows.groupBy("source", "__size", "__block").agg(F.count("*").alias("n"))
    counts = written(counts, "mixing-counts")
    sizes = counts.groupBy("source", "__size").agg(F.sum("n").alias("n"))
    targets = source_targets(sizes.withColumnRenamed("__size", "size"), weights, most)

    up_to = Window.partitionBy("source").orderBy("__size").rowsBetween(Window.unboundedPreceding, -1)
    shorter = sizes.select(
        F.col("source").alias("__s"), F.col("__size").alias("__n"), F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("__shorter"))
    equal = Window.partitionBy("source", "__size").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    plan = counts.withColumn("__equal", F.coalesce(F.sum("n").over(equal), F.lit(0)))
    plan = plan.join(shorter, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__size") == F.col("__n")))
    plan = plan.select("source", "__size", "__block", (F.col("__shorter") + F.col("__equal")).alias("__first"))
    targets = targets.select(
        F.col("source").alias("__t"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"))
    plan = plan.join(targets, F.col("source").eqNullSafe(F.col("__t"))).select(
        F.coalesce(F.col("source"), F.lit("")).alias("__named"), F.col("source").isNull().alias("__nameless"),
        "__size", "__block", "__first", "__source_size", "__target")
    plan = written(plan, "mixing-plan")

    block = ["__named", "__nameless", "__size", "__block"]
    rows = rows.withColumn("__place", F.row_number().over(Window.partitionBy(*block).orderBy("doc_id", "__digest")))
    rows = rows.join(plan, block)
    share = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    place, start = F.col("__first") + F.col("__place"), offset(F.col("source"), seed)
    crossed = F.floor(place * share + start) - F.floor((place - 1) * share + start)
    # Never above the limit, whatever the rounding of the sums.
    return rows.withColumn("__copies", F.least(crossed, F.lit(int(most))).cast("long"))


def copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = "0") -> DataFrame:
    """Per document: its columns, size, source_size, target, copies and taken words.

    Columns of the input with the names of the new ones are left out.
    """
    new = {
        "size": F.col("__size"), "source_size": F.col("__source_size"), "target": F.col("__target"),
        "copies": F.col("__copies"), "taken": F.col("__copies") * F.col("__size"),
    }
    kept = [c for c in docs.columns if c not in new]
    return _placed(docs, weights, most, seed).select(*kept, *[c.alias(name) for name, c in new.items()])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = MOST, seed: str = "0") -> DataFrame:
    """The mixed corpus: every document as often as it is taken, in its own columns."""
    rows = _placed(docs, weights, most, seed).where(F.col("__copies") > 0)
    each = F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int")))
    return rows.select(*docs.columns, each.alias("__copy")).select(*docs.columns)


ORACLE_SQL = f"""
WITH worded AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')), 0) AS size,
  md5(concat_ws(':', CAST(doc_id AS VARCHAR), text)) AS digest FROM documents),
blocked AS (SELECT *, CAST('0x' || substr(digest, 1, 4) AS BIGINT) % {SPREAD} AS block FROM worded),
sources AS (SELECT source, sum(size) AS source_size FROM blocked GROUP BY source),
weighed AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}
  {" ".join(f"WHEN {i} THEN {float(w)}" for i, w in enumerate(WEIGHTS))} END AS weight, source_size * {MOST} AS most FROM sources),
factors AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER b, 0.0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0)) AS factor FROM weighed
  WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT *, max(CASE WHEN factor * weight <= most THEN factor END) OVER () AS level FROM factors),
targets AS (SELECT source, source_size, least(most, coalesce(level * weight, most)) AS target,
  CAST(CAST('0x' || substr(md5('0:' || coalesce(source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS start FROM common),
placed AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source
  ORDER BY size, block, doc_id NULLS FIRST, digest) AS place FROM blocked),
shared AS (SELECT p.*, t.source_size, t.target, t.start,
  CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS share
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, round(target, 3) AS target,
  CAST(size * least(floor(place * share + start) - floor((place - 1) * share + start), {int(MOST)}) AS BIGINT) AS taken FROM shared
"""
