"""Document fingerprints by Order MinHash.

All k-mers of a text (``K`` code points each) are numbered by occurrence, so a repeated
k-mer counts as often as it stands there, and hashed to a place on a circle. Each of
``SKETCHES`` starting points on that circle orders the k-mers anew; the first ``TUPLE``
of an order are put back into text order and their hashes are hashed together. Two texts
agree in a component if they share the chosen k-mers in the same order, so likeness (the
share of equal components) falls with the edit distance, also where a plain set of
k-mers would stay the same.

Defined results: null is the empty text; a text shorter than K is one k-mer; an empty
text has the component 0 everywhere; two empty texts are alike (1.0); equal texts have
equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trafficlens.llm.words import U64, mix

#: Code points of a k-mer, number of components, k-mers in each.
K, SKETCHES, TUPLE = 8, 64, 2
#: Texts up to this many code points are sorted as one packed number per k-mer.
_PLACE_BITS = 24
_PLACES = U64((1 << _PLACE_BITS) - 1)
#: Rows in a sort group, and the most groups: their borders are known to every task.
GROUP_ROWS, GROUPS = 1000, 4096

_BASE = 0xD1342543DE82EF95
#: A number for every code point.
_POINTS = mix(np.arange(1, 0x110001, dtype=U64))
_powers: list[np.ndarray] = []


def _scales(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.concatenate(([U64(1)], np.cumprod(np.full(size, U64(x)))))
                      for x in (_BASE, pow(_BASE, -1, 2**64))]
    return _powers[0], _powers[1]


def _spread(x: np.ndarray) -> np.ndarray:
    """40 bits of an array that is changed in place."""
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x >>= U64(_PLACE_BITS)
    return x


def _sorted(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both, by hash and then by place; hashes have 40 bits."""
    if len(places) <= 1 << _PLACE_BITS:
        packed = hashes << U64(_PLACE_BITS)
        packed |= places
        packed.sort()
        return packed >> U64(_PLACE_BITS), packed & _PLACES
    order = np.lexsort((places, hashes))
    return hashes[order], places[order]


def fingerprint(text: str | None, k: int = K, sketches: int = SKETCHES, size: int = TUPLE) -> np.ndarray:
    """The components as unsigned 16-bit numbers."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(sketches, np.uint16)
    k = min(k, len(points))
    up, down = _scales(len(points) + 1)
    sums = np.zeros(len(points) + 1, U64)
    values = _POINTS[points]
    values *= up[:len(points)]
    np.cumsum(values, out=sums[1:])
    n = len(points) - k + 1
    hashes = sums[k:] - sums[:n]
    hashes *= down[:n]
    hashes = _spread(hashes)
    hashes, places = _sorted(hashes, np.arange(n, dtype=U64))
    again = hashes[1:] == hashes[:-1]
    if again.any():
        start = np.arange(n)
        start[1:][again] = 0
        number = np.arange(n) - np.maximum.accumulate(start)
        later = number > 0
        hashes[later] = _spread(mix(hashes[later] + (number[later].astype(U64) << U64(40))))
        hashes, places = _sorted(hashes, places)
    starts = (np.arange(sketches, dtype=U64) << U64(40)) // U64(sketches)
    chosen = (np.searchsorted(hashes, starts)[:, None] + np.arange(min(size, n))) % n
    chosen = np.take_along_axis(chosen, np.argsort(places[chosen], axis=1, kind="stable"), axis=1)
    out = np.zeros(sketches, U64)
    for column in hashes[chosen].T:
        out = mix(out + column + U64(1))
    return (out >> U64(48)).astype(np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.count_nonzero(a == b)) / len(a)


def text_form(components: np.ndarray) -> str:
    return components.astype(">u2").tobytes().hex()


def fingerprints(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """The documents with one column more; a column of that name is replaced."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def of(texts):
        return texts.map(lambda t: text_form(fingerprint(t)))

    return docs.withColumn(name, of(F.col(text)))


def _group(key: Column, borders: list[int]) -> Column:
    """How many borders are at or below the key, by halving."""
    levels = len(borders).bit_length()
    if not levels:
        return F.lit(0)
    padded = borders + [None] * (2**levels - 1 - len(borders))
    table = F.array(*[F.lit(x).cast("long") for x in padded])
    steps = F.array(*[F.lit(2**i) for i in reversed(range(levels))])
    return F.aggregate(
        steps, F.lit(0),
        lambda at, step: at + F.when(F.get(table, at + step - 1) <= key, step).otherwise(F.lit(0)))


def in_order(docs: DataFrame) -> DataFrame:
    """(__group, __ahead, __key, doc_id, text) dealt by group and sorted.

    Groups are ranges of doc_id. The first row of each group also stands at the end of
    the group before it, as ``__ahead``; that of the first group at the end of the last,
    so that a task finds the next document of all its rows. A null doc_id comes first.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("__key", F.coalesce(F.col("doc_id").cast("long"), F.lit(-2**63)))
    total = rows.count()
    wanted = min(GROUPS, -(-total // GROUP_ROWS))
    borders: list[int] = []
    if wanted > 1:
        # At most GROUPS numbers, whatever the number of documents.
        parts = [i / wanted for i in range(1, wanted)]
        borders = sorted(set(rows.agg(F.percentile_approx("__key", parts, 10 * GROUPS)).first()[0]))
    rows = rows.withColumn("__group", _group(F.col("__key"), borders))
    firsts = sorted((r["__group"], r["first"]) for r in rows.groupBy("__group").agg(F.min("__key").alias("first")).collect())
    if firsts:
        before = {first: firsts[i - 1][0] for i, (_, first) in enumerate(firsts)}
        table = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
        ahead = F.when(F.col("__key").isin(list(before)), F.element_at(table, F.col("__key")))
        places = F.filter(F.array(
            F.struct(F.col("__group").alias("group"), F.lit(False).alias("ahead")),
            F.struct(ahead.alias("group"), F.lit(True).alias("ahead"))), lambda x: x["group"].isNotNull())
        rows = rows.select("doc_id", "text", "__key", F.inline(places).alias("__group", "__ahead"))
    else:
        rows = rows.withColumn("__ahead", F.lit(False))
    return rows.repartition("__group").sortWithinPartitions(
        "__group", "__ahead", "__key", F.xxhash64("text")).select("__group", "__ahead", "__key", "doc_id", "text")


def with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fingerprints of each text, of its edited form, and likeness to that and the next."""
    import hashlib

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("__group", "__ahead", "doc_id", "text")))

    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], list(names))

    out, last = [], None
    for group, ahead, doc_id, text in rows():
        if last is None and ahead:
            continue
        own = fingerprint(text)
        if last is not None:
            now, now_id, now_text, now_print = last
            if now != group:
                raise ValueError(f"group {now} ends without the first row of the next one")
            cut = len(now_text) // 4
            edited = now_text[:len(now_text) - cut] + text[:cut]
            changed = fingerprint(edited)
            out.append((
                now_id, len(now_text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                text_form(now_print), text_form(changed), likeness(now_print, changed), likeness(now_print, own)))
            if len(out) >= 500:
                yield batch_of(out)
                out = []
        last = None if ahead else (group, doc_id, text, own)
    if out:
        yield batch_of(out)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """One row per document: its fingerprint against its edited text and the next one.

    The edited text has the last quarter of the code points replaced by the first as
    many of the next document in ascending doc_id (after the last: the first). Rows with
    the same doc_id follow each other by text. Only doc_id and text are read; a single
    document is its own next one; an empty table gives an empty table.
    """
    return in_order(docs).mapInArrow(
        with_neighbours,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double")
