"""N-gram Jaccard join: all texts whose sets of word shingles are alike enough.

Texts with equal sets form one class and are compared once. Two sets of a similarity of
``LEAST`` share at least one of their first shingles in any common order, if of each
set of n those left out are fewer than ``LEAST * n`` (prefix filter), so only classes that
meet at such a shingle are candidates. The order puts frequent shingles last; it decides
the cost and never the result.

First every class is compared with the smallest one that it meets, which joins most of
each group; then only classes that are not joined yet. For that, meeting points with the
same smallest class form one tile: its classes by size, cut into chunks, and only chunks
within the size band of each other are compared. Each class brings a bitmap of its hashed
shingles: those whose bit is missing in the other one bound the overlap from above, by
counting bits. Classes that are left with a pair come to their tile once more, with their
sorted sets, whose intersection decides. There the likeliest pairs go first, and a pair
that other links have joined meanwhile is not compared: a tile gives the links that join
its classes, fewer than it has classes, and not all links between them.

Shingles are 64-bit hashes of five words (two different ones agree with a chance of
about 2^-60), a class is a 64-bit hash of its set. Sets are made anew from the text
where they are needed, so that no table of all shingles is written.

Defined results: a text of fewer than five words is one shingle, one without words (or
null) is empty and linked with nothing; rows of one doc_id are rows of their own; a null
doc_id takes part and is never the smallest unless all are null; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trafficlens.llm import words as W
from trafficlens.llm.components import components
from trafficlens.llm.kept import release
from trafficlens.session import Scratch, written

U64 = np.uint64
#: Words of a shingle; similarity as a fraction.
WORDS, LEAST = 5, (3, 4)
#: Bits of a bitmap: a power of two that is at least twice the size of the set, in these
#: limits. With fewer bits a pair that shares a passage may not be told from a near copy.
FEWEST_BITS, MOST_BITS = 512, 65536
#: Words of 64 bits that a tile compares at once.
_AT_ONCE = 1 << 21
#: Classes in a chunk of a tile, and shingles of a chunk that holds sets (one more set may
#: lie across its end).
CHUNK, CHUNK_SHINGLES = 512, 1 << 19
#: Pairs of a tile that are compared before those joined meanwhile are left out.
_IN_TURN = 256
#: The most shingles that are put last because they are frequent, and the documents
#: (as counted within batches) that make one frequent.
FREQUENT, FREQUENT_DOCS = 1 << 20, 16
#: Slots of the table of frequent shingles, as a power of two.
_SLOT_BITS = 24
#: From this level on (32 times the limit) classes at a shingle meet in 256 parts first.
_SALTED = 6
#: Rows up to which a table of classes and rows goes to every executor: some 40 MB.
BROADCAST_ROWS = 1_000_000


def sets_of(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    data, starts = W.text_bytes(texts)
    for first, last, part, bounds in W.chunks(data, starts):
        shingles, owner = W.sequences(*W.words(part, bounds), n)
        ends = np.searchsorted(owner, np.arange(last - first + 1))
        for i in range(last - first):
            own = np.sort(shingles[ends[i]:ends[i + 1]])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
            yield own


def class_of(shingles: np.ndarray) -> int:
    """A signed number for a set."""
    total = W.mix(np.array([W.mix(shingles).sum(dtype=U64) + U64(len(shingles))], U64))
    return int(total.astype(np.int64)[0])


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, U64).astype(np.int64))


def repeated(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are in more than two of the sets, and in how many. Takes the sets
    out of the list: most shingles are rare, and all of them are held only once."""
    every = np.concatenate([np.zeros(0, U64), *sets])
    sets.clear()
    every.sort()
    third = every[2:]
    often = np.unique(third[third == every[:-2]])
    return often, np.searchsorted(every, often, "right") - np.searchsorted(every, often)


_SUMMARY = ["row", "doc_id", "n_shingles", "class", "bits", "shingle", "times"]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, doc_id, n_shingles, class, bits) and, apart, (shingle, times) that a batch
    repeats."""
    release()
    for batch in batches:
        counts, classes, bits, new, seen = [], [], [], [], set()
        for shingles in sets_of(batch.column("text")):
            counts.append(len(shingles))
            classes.append(class_of(shingles))
            bits.append(None)
            if classes[-1] not in seen:
                seen.add(classes[-1])
                new.append(shingles)
                bits[-1] = bitmap(shingles)
        nothing = pa.nulls(len(counts), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("row"), batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()),
             pa.array(classes, pa.int64()), pa.array(bits, pa.binary()), nothing, nothing], _SUMMARY)
        often, times = repeated(new)
        if len(often):
            nothing = pa.nulls(len(often), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [nothing] * 4 + [pa.nulls(len(nothing), pa.binary()), _signed(often), pa.array(times)], _SUMMARY)


def _slots(repeated: DataFrame) -> np.ndarray:
    """How frequent the shingles of a slot are: 0, or the doublings above the limit.

    The most frequent ones come to the driver, at most ``FREQUENT``; the table that goes
    to the tasks has a fixed size.
    """
    table = np.zeros(1 << _SLOT_BITS, np.uint8)
    times = repeated.groupBy("shingle").agg(F.sum("times").alias("times")).where(F.col("times") >= FREQUENT_DOCS)
    level = F.floor(F.log2(F.col("times") / FREQUENT_DOCS) + 1).cast("int")
    times = written(times.select("shingle", level.alias("level")), "jaccard-frequent")
    limit, total = 1, 0
    for row in sorted(times.groupBy("level").count().collect(), reverse=True):
        total += row["count"]
        if total > FREQUENT:
            limit = row["level"] + 1
            break
    rows = times.where(F.col("level") >= limit).toArrow()
    slot = np.asarray(rows.column("shingle")).astype(U64) >> U64(64 - _SLOT_BITS)
    np.maximum.at(table, slot.astype(np.int64), np.asarray(rows.column("level")).astype(np.uint8))
    return table


def first_shingles(shingles: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The prefix of a sorted set in the common order, frequent ones last."""
    n = len(shingles)
    if not n:
        return shingles
    level = slots[(shingles >> U64(64 - _SLOT_BITS)).astype(np.int64)]
    if level.any():
        shingles = shingles[np.argsort(level, kind="stable")]
    return shingles[:n - -(-LEAST[0] * n // LEAST[1]) + 1]


def _meetings(slots):
    """(shingle, class, size, salt) for the first shingles of every class of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        table, seen = slots.value, set()
        for batch in batches:
            for first in range(0, batch.num_rows, 2000):
                out, classes, sizes = [np.zeros(0, U64)], [], []
                for shingles in sets_of(batch.column("text").slice(first, 2000)):
                    name = class_of(shingles)
                    if not len(shingles) or name in seen:
                        continue
                    if len(seen) >= 1 << 20:
                        seen.clear()
                    seen.add(name)
                    out.append(first_shingles(shingles, table))
                    classes.append(name)
                    sizes.append(len(shingles))
                many = [len(x) for x in out[1:]]
                every = np.concatenate(out)
                classes = np.repeat(np.array(classes, np.int64), many)
                # Classes at a very frequent shingle meet in parts first.
                level = table[(every >> U64(64 - _SLOT_BITS)).astype(np.int64)]
                salt = np.where(level >= _SALTED, classes & 255, -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_signed(every), pa.array(classes), pa.array(np.repeat(np.array(sizes, np.int32), many)),
                     pa.array(salt)], ["shingle", "class", "size", "salt"])

    return run


def bitmap(shingles: np.ndarray) -> bytes:
    width = min(max(FEWEST_BITS, 2 << max(len(shingles) - 1, 0).bit_length()), MOST_BITS)
    bits = np.zeros(width, bool)
    bits[(shingles & U64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _folded(bits: list[bytes], width: int) -> np.ndarray:
    """Bitmaps of one or several widths, all brought to the smallest: halves are united."""
    out = np.zeros((len(bits), width // 64), np.uint64)
    for i, one in enumerate(bits):
        out[i] = np.bitwise_or.reduce(np.frombuffer(one, np.uint64).reshape(-1, width // 64), axis=0)
    return out


def most_shared(bits_a: list[bytes], bits_b: list[bytes], n, m, i, j) -> np.ndarray:
    """How many shingles the pairs (i of a, j of b), of sets of n[i] and m[j], share at most.

    A set bit that the other bitmap lacks is a shingle that the other set lacks.
    """
    wide_a, wide_b = (np.array([len(x) * 8 for x in bits]) for bits in (bits_a, bits_b))
    both, most = np.minimum(wide_a[i], wide_b[j]), np.zeros(len(i), np.int64)
    for width in np.unique(both):
        at = np.flatnonzero(both == width)
        rows, x = np.unique(i[at], return_inverse=True)
        columns, y = np.unique(j[at], return_inverse=True)
        a, b = _folded([bits_a[k] for k in rows], width), _folded([bits_b[k] for k in columns], width)
        step = max(1, _AT_ONCE // (width // 64))
        for first in range(0, len(at), step):
            here = at[first:first + step]
            p, q = a[x[first:first + step]], b[y[first:first + step]]
            most[here] = np.minimum(n[i[here]] - np.bitwise_count(p & ~q).sum(1, dtype=np.int64),
                                    m[j[here]] - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
    return most


def enough(shared, sizes):
    """Whether so many shared shingles are enough for two sets of so many together."""
    # shared / (sizes - shared) >= LEAST
    return shared * (LEAST[0] + LEAST[1]) >= LEAST[0] * sizes


def room_for(bits_a: list[bytes], bits_b: list[bytes], n, m, i, j) -> np.ndarray:
    """Which of the pairs (i of a, j of b), of sets of n[i] and m[j], may overlap enough."""
    return enough(most_shared(bits_a, bits_b, n, m, i, j), n[i] + m[j])


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets overlap enough."""
    both = np.sort(np.concatenate((x, y)))
    return bool(enough(int(np.count_nonzero(both[1:] == both[:-1])), len(both)))


def _sets(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), "<u8") for x in column]


def _class_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 500):
            part = batch.slice(first, 500)
            made = [x.astype("<u8").tobytes() for x in sets_of(part.column("text"))]
            yield pa.RecordBatch.from_arrays([part.column("class"), pa.array(made, pa.binary())], ["class", "shingles"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave room for enough overlap."""
    for batch in batches:
        for first in range(0, batch.num_rows, 4000):
            part = batch.slice(first, 4000)
            n, m = (np.asarray(part.column(c)).astype(np.int64) for c in ("size_a", "size_b"))
            k = np.arange(len(n))
            good = room_for(part.column("bits_a").to_pylist(), part.column("bits_b").to_pylist(), n, m, k, k)
            yield part.select(["a", "b"]).filter(pa.array(good))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [alike(x, y) for x, y in zip(_sets(batch.column("shingles_a")), _sets(batch.column("shingles_b")))]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _near(n, m):
    return (LEAST[1] * n >= LEAST[0] * m) & (LEAST[1] * m >= LEAST[0] * n)


def _classes_of(batch: pa.RecordBatch, row: int) -> tuple:
    """(size, class, joined, held) of two chunks, one behind the other, and where the second
    one begins."""
    sides = [batch.column("left")[row].values, batch.column("right")[row].values]
    columns = [np.concatenate([np.asarray(s.field(k)) for s in sides]) for k in ("size", "class", "joined")]
    return columns[0].astype(np.int64), *columns[1:], pa.concat_arrays([s.field("held") for s in sides]), len(sides[0])


def _pairs_of(size: np.ndarray, joined: np.ndarray, left: slice, right: slice) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): the pairs of two chunks, or of one, within the size band and not joined yet."""
    near = _near(size[left, None], size[right]) & (joined[left, None] != joined[right])
    i, j = np.nonzero(np.triu(near, 1) if left == right else near)
    return i + (left.start or 0), j + (right.start or 0)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tile, class, size, joined): classes with a pair in two chunks whose bitmaps leave
    room for enough overlap."""
    for batch in batches:
        for row in range(batch.num_rows):
            size, name, joined, bits, first = _classes_of(batch, row)
            left, right = slice(first), slice(first, None)
            i, j = _pairs_of(size, joined, left, left if first == len(size) else right)
            if not len(i):
                continue
            bits = bits.to_pylist()
            good = room_for(bits, bits, size, size, i, j)
            k = np.union1d(i[good], j[good])
            tile = np.full(len(k), batch.column("tile")[row].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile), pa.array(name[k]), pa.array(size[k].astype(np.int32)), pa.array(joined[k])],
                ["tile", "class", "size", "joined"])


def joining_links(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, joined: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs (i, j) of sets, links that join what all links between them join, and
    ``joined`` does not yet; it is brought up to date. The likeliest pairs go first."""
    if not len(i):
        return []
    size, bits = np.array([len(x) for x in sets], np.int64), [bitmap(x) for x in sets]
    most = most_shared(bits, bits, size, size, i, j)
    order = np.argsort(-most / (size[i] + size[j]), kind="stable")
    order = order[enough(most, size[i] + size[j])[order]]
    i, j, links = i[order], j[order], []
    while len(i):
        for x, y in zip(i[:_IN_TURN].tolist(), j[:_IN_TURN].tolist()):
            if joined[x] != joined[y] and alike(sets[x], sets[y]):
                links.append((x, y))
                joined[joined == joined[y]] = joined[x]
        i, j = i[_IN_TURN:], j[_IN_TURN:]
        apart = joined[i] != joined[j]
        i, j = i[apart], j[apart]
    return links


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): links that join the classes of a chunk; of two chunks, what links inside of
    each do not join (those come from the chunk itself)."""
    for batch in batches:
        for row in range(batch.num_rows):
            size, name, joined, held, first = _classes_of(batch, row)
            sets, parts = _sets(held), [slice(first), slice(first, None)]
            steps = [(x, x) for x in parts] + [tuple(parts)]
            if first == len(size):
                steps = steps[:1]
            for step in steps:
                links = joining_links(sets, *_pairs_of(size, joined, *step), joined)
            if links:
                a, b = (name[list(k)] for k in zip(*links))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _sets_of_classes(wanted: DataFrame, texts: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(class, shingles) of the ``wanted`` classes, from the text of one row of each."""
    one = scratch.written(classes.select("class", "row").join(wanted, "class"), "jaccard-rows")
    if one.count() <= BROADCAST_ROWS:
        one = F.broadcast(one)
    chosen = texts.join(one, "row").select("class", "text").dropDuplicates(["class"])
    return scratch.written(chosen.mapInArrow(_class_rows, "class long, shingles binary"), "jaccard-texts")


def _links(pairs: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs of classes, those that are alike enough."""
    scratch = Scratch()

    def side(name: str) -> DataFrame:
        return classes.select(F.col("class").alias(name), F.col("size").alias(f"size_{name}"), F.col("bits").alias(f"bits_{name}"))

    pairs = scratch.written(pairs.select("a", "b"), "jaccard-pairs")
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded, "a long, b long")
    pairs = scratch.written(pairs, "jaccard-near")
    wanted = pairs.select(F.col("a").alias("class")).union(pairs.select("b")).distinct()
    rows = _sets_of_classes(wanted, texts, classes, scratch)
    near = pairs.join(rows.select(F.col("class").alias("a"), F.col("shingles").alias("shingles_a")), "a")
    near = near.join(rows.select(F.col("class").alias("b"), F.col("shingles").alias("shingles_b")), "b")
    links = written(near.mapInArrow(_verified, "a long, b long"), "jaccard-links")
    scratch.clear()
    return links


def _compatible(a: str, b: str):
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def _stars(meetings: DataFrame, *by: str) -> DataFrame:
    """(shingle, class, size, salt, lead, lead_size) where several classes meet; the lead
    is the smallest set."""
    here = Window.partitionBy(*by)
    lead = F.min(F.struct("size", "class")).over(here)
    several = F.min("class").over(here) != F.max("class").over(here)
    met = meetings.withColumn("__lead", lead).withColumn("__several", several)
    met = met.where(F.col("__several") | (F.col("salt") >= 0))
    return met.select("shingle", "class", "size", "salt", F.col("__lead.class").alias("lead"), F.col("__lead.size").alias("lead_size"))


def _best_leads(stars: DataFrame) -> DataFrame:
    """For every class the lead that it meets most often."""
    met = stars.where((F.col("class") != F.col("lead")) & _compatible("size", "lead_size"))
    met = met.groupBy("class", "lead").agg(F.count("*").alias("n"))
    met = met.groupBy("class").agg(F.max(F.struct("n", "lead")).alias("best"))
    return met.select(F.col("best.lead").alias("a"), F.col("class").alias("b"))


def _joined(meetings: DataFrame, links: DataFrame) -> DataFrame:
    """The rows with the component of their class."""
    groups = components(links).select(F.col("id").alias("class"), F.col("component").alias("joined"))
    return meetings.join(groups, "class", "left").withColumn("joined", F.coalesce("joined", "class"))


def _chunk_pairs(rows: DataFrame, held: DataFrame, cost, most: int, scratch: Scratch, name: str) -> DataFrame:
    """(tile, left, right, same): the classes of each tile by size, with what is held of
    them (class, held), as pairs of chunks that have the size band in common. A chunk has
    classes of a cost of ``most``."""
    by_size, tile = Window.partitionBy("tile").orderBy("size", "class"), Window.partitionBy("tile")
    before = F.sum(cost).over(by_size) - cost
    rows = rows.withColumn("chunk", F.floor(before / most)).withColumn("chunks", F.max("chunk").over(tile))
    lists = rows.join(held, "class").groupBy("tile", "chunk", "chunks").agg(
        F.sort_array(F.collect_list(F.struct("size", "class", "joined", "held"))).alias("classes"),
        F.min("size").alias("low"), F.max("size").alias("high"))
    lists = scratch.written(lists, name)
    same = lists.select("tile", F.col("classes").alias("left"), F.slice("classes", 1, 0).alias("right"), F.lit(True).alias("same"))
    later = lists.where("chunk > 0").select(
        "tile", F.col("chunk").alias("chunk_b"), F.col("classes").alias("right"), F.col("low").alias("low_b"))
    # Only tiles of several chunks are moved for that.
    across = lists.where("chunks > 0").join(later, "tile").where(
        (F.col("chunk") < F.col("chunk_b")) & (LEAST[1] * F.col("high") >= LEAST[0] * F.col("low_b")))
    return same.unionByName(across.select("tile", F.col("classes").alias("left"), "right", F.lit(False).alias("same")))


def _remaining(meetings: DataFrame, texts: DataFrame, classes: DataFrame) -> DataFrame:
    """Links that join the classes that meet and are in different components so far."""
    scratch = Scratch()
    here = Window.partitionBy("shingle")
    rows = meetings.withColumn("__several", F.min("joined").over(here) != F.max("joined").over(here))
    rows = rows.withColumn("__lead", F.min(F.struct("size", "class")).over(here)).where("__several")
    # Most meeting points of a tile hold the same classes.
    rows = rows.select(F.col("__lead.class").alias("tile"), "class", "size", "joined").dropDuplicates(["tile", "class"])
    # Without another one in the size band a class has no pair here; bitmaps go only to the others.
    by_size = Window.partitionBy("tile").orderBy("size", "class")
    # Beyond either end of a tile stands 0, which is in no band.
    beside = [_compatible("size", f("size", 1, 0).over(by_size)) for f in (F.lag, F.lead)]
    rows = rows.withColumn("__beside", beside[0] | beside[1]).where("__beside").drop("__beside")
    bits = classes.select("class", F.col("bits").alias("held"))
    near = _chunk_pairs(rows, bits, F.lit(1), CHUNK, scratch, "jaccard-tiles")
    near = near.mapInArrow(_candidates, "tile long, class long, size int, joined long").distinct()
    near = scratch.written(near, "jaccard-near")
    sets = _sets_of_classes(near.select("class").distinct(), texts, classes, scratch)
    sets = sets.select("class", F.col("shingles").alias("held"))
    cost = F.greatest(F.col("size").cast("long"), F.lit(CHUNK_SHINGLES // CHUNK))
    found = _chunk_pairs(near, sets, cost, CHUNK_SHINGLES, scratch, "jaccard-set-tiles").mapInArrow(_tiles, "a long, b long")
    links = written(found.distinct(), "jaccard-links")
    scratch.clear()
    return links


def classes_joined(texts: DataFrame, classes: DataFrame, repeated: DataFrame) -> DataFrame:
    """(class, joined): every linked class and the smallest class of its component."""
    slots = texts.sparkSession.sparkContext.broadcast(_slots(repeated))
    meetings = texts.mapInArrow(_meetings(slots), "shingle long, class long, size int, salt int")
    met = written(_stars(meetings, "shingle", "salt"), "jaccard-met")
    # Workers need not keep the table for the steps and stages to come.
    slots.unpersist()
    links = _links(_best_leads(met), texts, classes)
    # Where classes met in parts, the parts meet now, by one class of each component.
    parted = met.where("salt >= 0").select("shingle", "class", "size")
    if not parted.isEmpty():
        one = _joined(parted, links).groupBy("shingle", "joined").agg(F.min(F.struct("size", "class")).alias("one"))
        one = one.select("shingle", "one.class", "one.size", F.lit(-1).alias("salt"))
        links = links.unionByName(_links(_best_leads(_stars(one, "shingle")), texts, classes))
    links = links.unionByName(_remaining(_joined(met.select("shingle", "class", "size"), links), texts, classes))
    return components(links).select(F.col("id").alias("class"), F.col("component").alias("joined"))


def _grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(row, doc_id, n_shingles, joined) of every row, by classes; texts with row names."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # A row is named by its content, so null and repeated doc_ids do no harm.
    texts = texts.withColumn("row", F.xxhash64("doc_id", "text"))
    found = written(texts.mapInArrow(
        _summaries, "row long, doc_id long, n_shingles long, class long, bits binary, shingle long, times long"), "jaccard-sets")
    sets = found.where("class is not null").select("row", "doc_id", "n_shingles", "class")
    classes = found.where("bits is not null").groupBy("class").agg(
        F.min("row").alias("row"), F.first("n_shingles").alias("size"), F.first("bits").alias("bits"))
    classes = written(classes.where("size > 0"), "jaccard-classes")
    linked = classes_joined(texts, classes, found.where("shingle is not null").select("shingle", "times"))
    groups = sets.join(linked, "class", "left")
    return groups.select("row", "doc_id", "n_shingles", F.coalesce("joined", "class").alias("joined"))


def link(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id is the smallest
    doc_id that is reached over links, its own included."""
    rows = _grouped(docs)
    groups = rows.where("n_shingles > 0")
    smallest = groups.groupBy("joined").agg(F.min("doc_id").alias("component_id"))
    out = groups.join(smallest, "joined").select("doc_id", "n_shingles", "component_id")
    empty = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return out.unionByName(empty)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with the smallest doc_id of each component, and those without words.

    Of rows that are alike in doc_id and text one stays.
    """
    rows = written(_grouped(docs).where("n_shingles > 0").select("row", "doc_id", "joined"), "jaccard-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    kept = rows.groupBy("joined").agg(first.alias("first"))
    gone = rows.join(kept, "joined").where(F.col("row") != F.col("first.row")).select(F.col("row").alias("__row")).distinct()
    gone = written(gone, "jaccard-gone")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    named = docs.withColumn("__row", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    left = named.join(gone, "__row", "left_anti")
    again = written(rows.groupBy(F.col("row").alias("__row")).count().where("count > 1").select("__row"), "jaccard-again")
    if not again.isEmpty():
        single = left.join(again, "__row", "left_semi").dropDuplicates(["__row"])
        left = left.join(again, "__row", "left_anti").unionByName(single)
    return left.select(*docs.columns)


ORACLE_SQL = f"""
WITH RECURSIVE worded AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\x0B\f\r]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 OR w IS NULL THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
  ELSE list_distinct([array_to_string(w[i:i + {WORDS - 1}], ' ') FOR i IN range(1, len(w) - {WORDS - 2})]) END AS s FROM worded),
single AS (SELECT doc_id, len(s) AS n, unnest(s) AS sh FROM sets),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS n, any_value(y.n) AS m, count(*) AS shared_n
  FROM single x JOIN single y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * shared_n >= 75 * (n + m - shared_n)),
sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT a AS id, a AS root FROM sides UNION SELECT r.id, s.b FROM reached r JOIN sides s ON s.a = r.root),
roots AS (SELECT id, min(root) AS root FROM reached GROUP BY id)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id
FROM sets LEFT JOIN roots ON id = doc_id
"""
