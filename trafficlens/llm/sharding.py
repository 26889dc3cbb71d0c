"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``VIRTUAL`` places on a ring of 64-bit hashes; a document belongs to
the first place clockwise of its own hash. A shard takes at most its bound; documents
beyond it go on clockwise to the next place whose shard has room. The bounds are the
number of documents over the number of shards, rounded down or, for the first shards,
up. They add up to all documents, so every shard is exactly full and counts differ by
one at most (the law ``rows``), while most documents stay where the ring puts them.

Only counts per arc (the stretch before a place) go to the driver: one number for each
of ``shards * virtual`` arcs, whatever the number of documents. The walk gives each arc
ranges of ranks and their shards. A document's rank in its arc comes from a window per
arc; the slot in its shard follows from the ranges, so no window runs over a whole shard.

Nulls and odd cases: a null text has size 16 and the crc32 of no bytes; a null doc_id
is hashed as a value of its own, with the text, so that many of them spread; rows alike
in doc_id and text are separate documents; an empty table gives an empty table; input
columns with the names of the new ones are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trafficlens.llm.tables import crc32_of, small_table, text_of
from trafficlens.session import written

SHARDS = 40
VIRTUAL = 64
#: Bytes that every document takes besides its text.
OVERHEAD = 16
#: The ring in 4096 equal cells, to look up an arc by an equal join.
_CELL_BITS = 52


def ring(spark: SparkSession, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """(arc, shard, low, high): positions above low, up to high, belong to the arc.

    Arcs are numbered clockwise from the smallest signed hash. The arc of the first
    place is in two pieces: up to it, and from the last place to the end of the ring.
    The windows run over the places of the ring, not over documents.
    """
    places = spark.range(shards * virtual).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.xxhash64(F.lit("place"), (F.col("id") % shards), F.floor(F.col("id") / shards)).alias("high"),
    )
    places = places.groupBy("high").agg(F.min("shard").alias("shard"))
    order = Window.orderBy("high")
    places = places.select(
        (F.row_number().over(order) - 1).alias("arc"), "shard",
        F.lag("high").over(order).alias("low"), "high")
    last = places.agg(F.max("high").alias("low"))
    tail = places.where("arc = 0").select("arc", "shard").crossJoin(last).select(
        "arc", "shard", "low", F.lit(2**63 - 1).alias("high"))
    return places.unionByName(tail)


def _cells(arcs: DataFrame) -> DataFrame:
    """Arcs once for every cell of the ring that they touch."""
    low = F.coalesce("low", F.lit(-2**63))
    spread = arcs.withColumn("__from", F.shiftright(low, _CELL_BITS)).withColumn("__to", F.shiftright("high", _CELL_BITS))
    return spread.select("arc", "low", "high", F.explode(F.sequence("__from", "__to")).alias("cell"))


def walk(counts: list[int], owners: list[int], shards: int) -> list[tuple[int, int, int, int]]:
    """(arc, first rank, rank behind the last, shard) after the overflow has moved on.

    Shards first take their own arcs, clockwise; then every overflow, clockwise, goes on
    to the places behind its own until it has found room.
    """
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    out, over = [], []
    for arc, (n, shard) in enumerate(zip(counts, owners)):
        kept = min(n, room[shard])
        room[shard] -= kept
        if kept:
            out.append((arc, 0, kept, shard))
        if kept < n:
            over.append((arc, kept, n))
    for arc, rank, end in over:
        place = arc
        while rank < end:
            place = (place + 1) % len(owners)
            taken = min(room[owners[place]], end - rank)
            if taken:
                room[owners[place]] -= taken
                out.append((arc, rank, rank + taken, owners[place]))
                rank += taken
    return out


def shard(docs: DataFrame, shards: int = SHARDS, virtual: int = VIRTUAL) -> DataFrame:
    """The documents' columns and size, text_crc32, law, shard, slot, grown_shard."""
    spark = docs.sparkSession
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    kept = [c for c in docs.columns if c not in new]
    text = text_of()
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit("none"), text)).otherwise(F.xxhash64(F.lit("doc"), "doc_id"))
    rows = docs.withColumns({
        "size": F.octet_length(text).cast("long") + OVERHEAD, "text_crc32": crc32_of(text), "__position": key,
    }).select(*kept, "size", "text_crc32", "__position")
    # The number of arcs is fixed by the parameters, and so is the size of these tables.
    arcs = written(ring(spark, shards, virtual), "ring")
    cells = F.broadcast(_cells(arcs))
    at = F.shiftright(F.col("__position"), _CELL_BITS)
    inside = (F.col("__position") <= F.col("high")) & (F.col("low").isNull() | (F.col("__position") > F.col("low")))
    rows = rows.join(cells, (at == F.col("cell")) & inside).drop("low", "high", "cell")

    owner = {r["arc"]: r["shard"] for r in arcs.select("arc", "shard").distinct().collect()}
    found = {r["arc"]: r["n"] for r in rows.groupBy("arc").agg(F.count("*").alias("n")).collect()}
    owners = [owner[a] for a in range(len(owner))]
    ranges = walk([found.get(a, 0) for a in range(len(owners))], owners, shards)
    filled = [0] * shards
    table = []
    for arc, start, end, to in ranges:
        table.append({"__arc": arc, "__start": start, "__end": end, "__shard": to, "__slot": filled[to]})
        filled[to] += end - start
    plan = F.broadcast(small_table(spark, table, "__arc int, __start long, __end long, __shard int, __slot long"))

    order = Window.partitionBy("arc").orderBy("__position", "doc_id", "text_crc32", "size")
    rows = rows.withColumn("__rank", F.row_number().over(order) - 1)
    rows = rows.join(plan, (F.col("arc") == F.col("__arc")) & (F.col("__rank") >= F.col("__start"))
                     & (F.col("__rank") < F.col("__end")))
    return rows.select(
        *kept, "size", "text_crc32", F.lit("rows").alias("law"), F.col("__shard").alias("shard"),
        (F.col("__slot") + F.col("__rank") - F.col("__start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
