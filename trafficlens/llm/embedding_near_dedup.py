"""Embedding near-dedup by sorted projection passes and an exact comparison of chunks.

Vectors with equal label and components form one class. In every pass a class gets the
signs of its products with ``HASHES`` random directions, as one number; classes are
sorted by label and that number, so those whose first hashes agree stand together, and
each is compared with the ``WINDOW`` before it. Verified pairs of all passes are united to
groups. The passes only group: a window cuts a dense neighbourhood, and how many passes
would be enough depends on how the vectors lie.

Every pair of a label is then settled. Its classes are cut into chunks, those of a large
group apart; two chunks whose centres and radii leave no doubt count as wholly linked or
not at all, and all others are compared vector by vector. That counts the links, and links
between groups unite them. No pair of a group is written. The cost grows with the square
of a label where centres and radii decide little, that is where vectors lie evenly round
the origin; tight groups are settled by their bounds.

In the passes a task compares within its own range of the order.

Defined results: a vector that is null, empty, zero, or holds null, NaN or infinity, or
whose label is null, is linked with nothing; vectors of different length are not
compared; repeated rows are vectors of their own, linked with each other; a null vec_id
takes part and is never the smallest unless all are null; an empty table gives an empty
table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from trafficlens.llm.components import components
from trafficlens.session import written

LEAST = 0.93
#: Chance to compare a pair of exactly that cosine in some pass.
RECALL = 0.999
#: Neighbours that a vector is compared with, and random directions of a pass.
WINDOW, HASHES = 32, 60
#: Classes in a chunk at most; chunks that a task cuts together, and chunks of a label that
#: meet the others of it under one join key.
CHUNK, CUT, SALTED = 256, 16, 256
SEED = 7
#: Rows of a sorted batch that are compared at once.
_ROWS = 4096


def usable(label: Column, vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(label.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def passes_for(largest: int, least: float = LEAST, recall: float = RECALL, window: int = WINDOW) -> int:
    """Passes after which a pair at the threshold has met with the wanted chance."""
    hashes = max(0.0, math.log2(max(largest, 1) / window)) + 1
    chance = (1 - math.acos(least) / math.pi) ** hashes
    return max(2, math.ceil(math.log(1 - recall) / math.log(1 - chance)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of unit length, in double precision; all vectors of the array are equally long."""
    flat = np.asarray(column.flatten()).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    # First by the largest component, so that squares neither vanish nor overflow.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _codes(matrix: np.ndarray, i: int) -> np.ndarray:
    """The signs of the products with the directions of a pass, as one number."""
    directions = np.random.Generator(np.random.PCG64([SEED, i])).standard_normal((matrix.shape[1], HASHES))
    return (((matrix @ directions) > 0) @ (1 << np.arange(HASHES - 1, -1, -1, dtype=np.int64))).astype(np.int64)


def _hashed(passes: int):
    """(pass, label, length, code, class, vector) for every pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.asarray(batch.column("length"))
            for length in np.unique(lengths):
                rows = batch.filter(pa.array(lengths == length))
                matrix = _matrix(rows.column("vector"))
                for i in range(passes):
                    codes = _codes(matrix, i)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(rows), i, np.int32)), rows.column("label"), rows.column("length"),
                         pa.array(codes), rows.column("class"), rows.column("vector")],
                        ["pass", "label", "length", "code", "class", "vector"])

    return run


class _Union:
    """Which classes of a task are joined already; forgotten when it has grown large."""

    def __init__(self):
        self.root: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = self.root
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def join(self, x: int, y: int) -> bool:
        if len(self.root) > 1_000_000:
            self.root.clear()
        x, y = self.find(x), self.find(y)
        if x != y:
            self.root[max(x, y)] = min(x, y)
        return x != y


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of neighbours that are alike; pairs that add nothing to a task's earlier
    ones are left out."""
    united, kept = _Union(), None
    for batch in batches:
        for first in range(0, batch.num_rows, _ROWS):
            part = pa.Table.from_batches([batch.slice(first, _ROWS)])
            if kept is not None:
                part = pa.concat_tables([kept, part]).combine_chunks()
            kept = part.slice(max(0, len(part) - WINDOW))
            keys = [np.asarray(part.column(c).combine_chunks()) for c in ("pass", "label", "length")]
            names = np.asarray(part.column("class").combine_chunks())
            groups = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], axis=0))))
            found = []
            for start, end in zip(groups, [*groups[1:], len(part)]):
                matrix = _matrix(part.column("vector").slice(start, end - start).combine_chunks())
                for step in range(1, min(WINDOW, end - start - 1) + 1):
                    near = np.flatnonzero(np.einsum("ij,ij->i", matrix[step:], matrix[:-step]) >= LEAST)
                    found.append((names[start + near + step], names[start + near]))
            pairs = [(int(x), int(y)) for a, b in found for x, y in zip(a, b) if x != y and united.join(int(x), int(y))]
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


# --- every pair of a label -----------------------------------------------------

_PACK = ("chunk long, n long, first long, classes binary, copies binary, groups binary, vectors binary, links binary, "
         "joined binary, centre array<double>, radius double")


def _angle(cosine) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def _cut(matrix: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Rows in chunks, halved again and again where they spread most."""
    if len(rows) <= CHUNK:
        yield rows
        return
    part = matrix[rows] - matrix[rows].mean(axis=0)
    direction = part[np.argmax(np.einsum("ij,ij->i", part, part))]
    for _ in range(3):
        direction = part.T @ (part @ direction)
        direction = direction / max(np.linalg.norm(direction), 1e-300)
    order = np.argsort(part @ direction, kind="stable")
    half = -(-len(rows) // CHUNK) // 2 * CHUNK
    for side in (order[:half], order[half:]):
        yield from _cut(matrix, rows[side])


def _joined(united: _Union, near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of groups that links join and that no earlier link of the task did."""
    i, j = np.nonzero(near & (a[:, None] != b[None, :]))
    both = np.unique(np.stack((a[i], b[j]), axis=1), axis=0)
    return [(x, y) for x, y in both.tolist() if united.join(x, y)]


def _chunk(rows: pa.Table, matrix: np.ndarray, number: int, united: _Union) -> pa.RecordBatch:
    """One row for a chunk: its classes, their links inside it, its centre and radius."""
    names, copies, groups = (np.asarray(rows.column(c).combine_chunks()).astype("<i8") for c in ("class", "copies", "group"))
    near = matrix @ matrix.T >= LEAST
    # A class is always alike itself, whatever the rounding.
    np.fill_diagonal(near, True)
    joined = np.array(_joined(united, near, groups, groups), "<i8")
    centre = matrix.mean(axis=0)
    norm = np.linalg.norm(centre)
    centre = centre / norm if norm > 1e-9 else matrix[0]
    blobs = (names, copies, groups, matrix.astype("<f8"), (near @ copies).astype("<i8"), joined)
    return pa.RecordBatch.from_arrays([
        *(rows.column(c).combine_chunks().slice(0, 1) for c in ("label", "length")), pa.array([number], pa.int64()),
        pa.array([int(copies.sum())], pa.int64()), pa.array([int(groups[0])], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs),
        pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(_angle(matrix @ centre).max())])],
        ["label", "length", *(c.split()[0] for c in _PACK.split(", "))])


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the code of a pass, so that those of a task lie near each other."""
    for batch in batches:
        lengths = np.asarray(batch.column("length"))
        for length in np.unique(lengths):
            rows = batch.filter(pa.array(lengths == length))
            yield rows.append_column("code", pa.array(_codes(_matrix(rows.column("vector")), 0)))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows in chunks; a chunk holds one label, length and large group."""
    from pyspark import TaskContext

    number, united, kept = TaskContext.get().partitionId() << 32, _Union(), None

    def packed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        nonlocal number
        matrix = _matrix(rows.column("vector").combine_chunks())
        for part in _cut(matrix, np.arange(len(rows))):
            yield _chunk(rows.take(pa.array(part)), matrix[part], number, united)
            number += 1

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if kept is not None:
            rows = pa.concat_tables([kept, rows]).combine_chunks()
        keys = [rows.column(c).combine_chunks() for c in ("label", "length", "large")]
        changed = np.zeros(max(len(rows) - 1, 0), bool)
        for key in keys:
            changed |= np.asarray(pc.not_equal(key[1:], key[:-1]).fill_null(True))
        borders = [0, *(np.flatnonzero(changed) + 1).tolist(), len(rows)]
        kept = None
        for start, end in zip(borders, borders[1:]):
            while end - start > CUT * CHUNK:
                yield from packed(rows.slice(start, CUT * CHUNK))
                start += CUT * CHUNK
            if end == len(rows):
                kept = rows.slice(start)
            elif end > start:
                yield from packed(rows.slice(start, end - start))
    if kept is not None and len(kept):
        yield from packed(kept)


#: ``links`` vectors linked with ``class``; or, without them, a group joined with another.
_FOUND = "class long, links long, other long"


def _found(names: list, links: list, joined: list) -> Iterator[pa.RecordBatch]:
    if names:
        once, at = np.unique(np.concatenate(names), return_inverse=True)
        sums = np.zeros(len(once), np.int64)
        np.add.at(sums, at, np.concatenate(links))
        yield pa.RecordBatch.from_arrays(
            [pa.array(once), pa.array(sums), pa.nulls(len(once), pa.int64())], ["class", "links", "other"])
    if joined:
        a, b = (pa.array(x, pa.int64()) for x in zip(*joined))
        yield pa.RecordBatch.from_arrays([a, pa.nulls(len(joined), pa.int64()), b], ["class", "links", "other"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the classes of two chunks have with the other chunk."""
    united = _Union()
    for batch in batches:
        names, links, joined = [], [], []
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            sides = []
            for s in ("a", "b"):
                own, copies, groups = (np.frombuffer(row[f"{c}_{s}"], "<i8") for c in ("classes", "copies", "groups"))
                sides.append((own, copies, groups, np.frombuffer(row[f"vectors_{s}"], "<f8").reshape(len(own), -1)))
            (a, n, g, x), (b, m, h, y) = sides
            near = x @ y.T >= LEAST
            if near.any():
                for own, sums in ((a, near @ m), (b, near.T @ n)):
                    names.append(own[sums > 0])
                    links.append(sums[sums > 0])
                joined += _joined(united, near, g, h)
        yield from _found(names, links, joined)


def _inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the classes of a chunk have in it and in chunks that are wholly linked with it."""
    united = _Union()
    for batch in batches:
        for row in batch.select(["classes", "links", "groups", "joined", "more"]).to_pylist():
            names, links, groups, joined = (np.frombuffer(row[c], "<i8") for c in ("classes", "links", "groups", "joined"))
            joined = [tuple(x) for x in joined.reshape(-1, 2).tolist()]
            if row["more"]:
                # All are linked with the same others.
                joined += [(x, int(groups[0])) for x in np.unique(groups).tolist() if united.join(x, int(groups[0]))]
            yield from _found([names], [links + row["more"]], joined)


def _settled(members: DataFrame) -> DataFrame:
    """``_FOUND`` of the classes in (label, length, large, group, class, copies, vector): how
    many vectors each is linked with, its own copies included, and which groups links join."""
    key = ["label", "length"]
    order = (*key, "large", "code", "class")
    coded = members.mapInArrow(_ordered, members.withColumn("code", F.lit(0).cast("long")).schema)
    ranged = coded.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = T.StructType([*members.select(*key).schema.fields, *T.StructType.fromDDL(_PACK).fields])
    packs = written(ranged.mapInArrow(_chunks, schema), "embedding-chunks")
    short = packs.select(*key, "chunk", "n", "first", "centre", "radius")
    # A label's chunks meet in parts: one side has a part, the other goes to all parts.
    parts = short.groupBy(*key).agg(F.ceil(F.count("*") / SALTED).cast("int").alias("parts"))
    short = short.join(parts, key)
    names = ("chunk", "n", "first", "centre", "radius")
    a, b = (short.withColumnsRenamed({c: f"{c}_{s}" for c in names}) for s in "ab")
    a = a.withColumn("part", F.pmod(F.xxhash64("chunk_a"), F.col("parts")).cast("int")).drop("parts")
    b = b.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    apart = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(
        F.zip_with("centre_a", "centre_b", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))))
    limit, slack = math.acos(LEAST), 1e-6
    both = a.join(b, [*key, "part"]).where("chunk_a < chunk_b")
    both = both.withColumn("__apart", apart).withColumn("__reach", F.col("radius_a") + F.col("radius_b"))
    all_linked = F.col("__apart") + F.col("__reach") < limit - slack
    none = F.col("__apart") - F.col("__reach") > limit + slack
    both = written(both.where(~none).select("chunk_a", "chunk_b", "n_a", "n_b", "first_a", "first_b", all_linked.alias("sure")), "embedding-pairs")
    sure = both.where("sure")
    more = sure.select(F.col("chunk_a").alias("chunk"), F.col("n_b").alias("n")).unionByName(
        sure.select(F.col("chunk_b").alias("chunk"), F.col("n_a").alias("n")))
    more = more.groupBy("chunk").agg(F.sum("n").alias("more"))
    inside = packs.join(more, "chunk", "left").select("classes", "links", "groups", "joined", F.coalesce("more", F.lit(0)).alias("more"))
    # Two wholly linked chunks join their first groups, on which their others hang.
    ends = sure.where("first_a <> first_b").select(
        F.col("first_a").alias("class"), F.lit(None).cast("long").alias("links"), F.col("first_b").alias("other")).distinct()
    names = ("chunk", "classes", "copies", "groups", "vectors")
    a, b = (packs.select(*names).withColumnsRenamed({c: f"{c}_{s}" for c in names}) for s in "ab")
    unsure = both.where(~F.col("sure")).select("chunk_a", "chunk_b").join(a, "chunk_a").join(b, "chunk_b")
    compared = inside.mapInArrow(_inside, _FOUND).unionByName(unsure.mapInArrow(_compared, _FOUND))
    return written(compared.unionByName(ends), "embedding-links")


def near_dedup(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    rows = vectors.select("vec_id", "label", F.col("embedding").alias("vector"))
    rows = rows.withColumn("class", F.when(usable(F.col("label"), F.col("vector")), F.xxhash64("label", "vector")))
    classes = rows.where(F.col("class").isNotNull()).groupBy("class").agg(
        F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("copies"),
        F.min("vec_id").alias("first"))
    classes = written(classes.withColumn("length", F.size("vector")), "embedding-classes")
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    hashed = classes.select("class", "label", "length", "vector").mapInArrow(
        _hashed(passes_for(largest)),
        classes.select(F.lit(0).alias("pass"), "label", "length", F.lit(0).cast("long").alias("code"), "class", "vector").schema)
    order = ("pass", "label", "length", "code", "class")
    links = hashed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_windows, "a long, b long")
    groups = written(components(links).select(F.col("id").alias("class"), "component"), "embedding-groups")
    sizes = groups.groupBy("component").agg((F.count("*") >= CHUNK // 4).alias("large"))
    found = classes.join(groups.join(sizes, "component"), "class", "left")
    settled = _settled(found.select(
        "label", "length", F.when(F.col("large"), F.col("component")).otherwise(0).alias("large"),
        F.coalesce("component", "class").alias("group"), "class", "copies", "vector"))
    counts = settled.where("links is not null").groupBy("class").agg(F.sum("links").alias("links"))
    joined = settled.where("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b"))
    if not joined.isEmpty():
        links = groups.select(F.col("class").alias("a"), F.col("component").alias("b")).unionByName(joined)
        groups = written(components(links).select(F.col("id").alias("class"), "component"), "embedding-groups")
    members = classes.join(groups, "class")
    smallest = members.groupBy("component").agg(F.min("first").alias("component_id"))
    grouped = groups.join(smallest, "component").join(counts, "class").select("class", "component_id", "links")
    found = classes.select("class", "copies", "first").join(grouped, "class", "left").select(
        F.col("class"), F.coalesce("component_id", "first").alias("component_id"),
        (F.coalesce("links", "copies") - 1).alias("n_links"))
    linked = rows.where(F.col("class").isNotNull()).select("vec_id", "class").join(found, "class")
    alone = rows.where(F.col("class").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.select("vec_id", "n_links", "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


ORACLE_SQL = f"""
WITH RECURSIVE fine AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM fine x JOIN fine y ON x.label = y.label AND x.vec_id <> y.vec_id
  AND len(x.v) = len(y.v) AND list_cosine_similarity(x.v, y.v) >= {LEAST}),
reached AS (SELECT a AS id, a AS root FROM links UNION SELECT r.id, l.b FROM reached r JOIN links l ON l.a = r.root),
roots AS (SELECT id, min(root) AS root FROM reached GROUP BY id),
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN counted ON a = vec_id LEFT JOIN roots ON id = vec_id
"""
