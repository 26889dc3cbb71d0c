"""Language-model scores from a log-frequency Bloom filter of n-gram counts.

Words and pairs of neighbouring words of the training texts are counted over the whole
corpus: tasks count their own texts, counts meet by ranges of hashes and are added up.
A count c is kept as a level, the number of steps of ``STEP`` below it, and the filter
holds the n-gram with every level up to its own. A reader asks for level 1, 2, ... until
the first miss; the answer is never too low and, but for false hits, right. Each range
of hashes has its own part of the filter, made where its counts meet, sized by what it
holds; the parts are a table. A filter of up to ``MOST_BITS`` is broadcast. For a larger
one, the distinct n-grams of some texts at a time go to the parts by a shuffle, and their
levels come back to the texts. Both ways give the same levels, of all counts.

The model: p(w | v) = (count(v w) + m p(w)) / (count(v) + m) with p(w) = (count(w) + 1) /
(N + V + 1), both from the filter; m is chosen from ``PRIORS`` by leaving each pair of all
training texts out once. Texts are read once for that: each gets its score under every
prior, and the likeliest is taken afterwards. A text begins behind a start mark and ends
with an end token.

The base score uses exact counts. The ``TOP`` most frequent words go to every task (a
fixed size); the other words of a text are joined with the table of all counts.

Defined results: null is the empty text, with the end token alone; a null doc_id is not
held out; without training texts N = V = 0 and every known count is 0; repeated rows are
rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trafficlens.llm import words as W
from trafficlens.session import written

U64 = np.uint64
#: Ratio of two neighbouring levels.
STEP = 2.0 ** 0.5
#: Bits of the filter for an n-gram at a level, bits up to which the whole filter is
#: broadcast, and places that an entry sets.
ENTRY_BITS, MOST_BITS, PROBES = 8, 1 << 29, 4
#: Words whose exact counts every task holds (16 bytes each).
TOP = 1 << 20
#: UTF-8 bytes of text for each range of hashes.
RANGE_BYTES = 16 << 20
#: Chunks of texts that ask a filter in parts together, for each range.
CHUNKS = 4
#: Tokens whose counts a task holds before it hands them on.
TASK_TOKENS = 1_500_000
PRIORS = (1.0, 5.0, 20.0, 100.0, 500.0, 2000.0, 10000.0, 100000.0)

END, START = U64(0x51ED270B9F3C4A11), U64(0x2C7F1D93B5A8E067)
_LEVELS = 2 * 64


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 7 == 2, F.lit(False))


def tokens(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, tokens, bounds) of some texts at a time; each ends with END."""
    data, starts = W.text_bytes(texts)
    for first, last, part, bounds in W.chunks(data, starts):
        hashes, at = W.words(part, bounds)
        n = np.diff(at)
        out = np.full(len(hashes) + len(n), END)
        ends = np.cumsum(n + 1)
        keep = np.ones(len(out), bool)
        keep[ends - 1] = False
        out[keep] = hashes
        yield first, out, np.concatenate(([0], ends))


def pairs(stream: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the token before and the token, the token before) at every token."""
    before = np.empty_like(stream)
    before[1:] = stream[:-1]
    before[bounds[:-1]] = START
    return W.mix(before * U64(0x9FB21C651E98DF25) + stream), before


def level(counts: np.ndarray) -> np.ndarray:
    return (np.floor(np.log(counts) / np.log(STEP) + 1e-9) + 1).astype(np.int64)


def _values() -> np.ndarray:
    """What a level stands for: the middle of the counts that it covers."""
    out = np.zeros(_LEVELS + 1)
    for i in range(1, _LEVELS + 1):
        low, high = np.ceil(STEP ** (i - 1) - 1e-6), np.ceil(STEP ** i - 1e-6) - 1
        out[i] = (low + max(low, high)) / 2
    return out


VALUES = _values()


# --- the filter ---------------------------------------------------------------

@dataclasses.dataclass(frozen=True)
class Model:
    """The filter in parts, the totals, and the most frequent words with their counts."""

    bits: np.ndarray
    part_start: np.ndarray
    part_bits: np.ndarray
    total: int
    distinct: int
    texts: int
    top: np.ndarray
    top_counts: np.ndarray

    def levels(self, grams: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it is not there."""
        part = range_of(grams, len(self.part_bits))
        return levels_in(self.bits, self.part_start[part], self.part_bits[part], grams)


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return (((hashes >> U64(32)) * U64(ranges)) >> U64(32)).astype(np.int64)


def _places(grams: np.ndarray, i, bits) -> Iterator[np.ndarray]:
    x = W.mix(grams + np.asarray(i).astype(U64) * U64(0xA24BAED4963EE407))
    a, b = x & U64(0xFFFFFFFF), (x >> U64(32)) | U64(1)
    bits = np.asarray(bits).astype(U64)
    for k in range(PROBES):
        yield (((a + U64(k) * b) & U64(0xFFFFFFFF)) * bits) >> U64(32)


def _hit(bits: np.ndarray, start: np.ndarray, size: np.ndarray, grams: np.ndarray, i: int) -> np.ndarray:
    good = np.ones(len(grams), bool)
    for place in _places(grams, i, size):
        place = place.astype(np.int64) + start
        good &= (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
    return good


def levels_in(bits: np.ndarray, start: np.ndarray, size: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """The level of each n-gram by its part of ``size`` bits from ``start`` on."""
    out = np.zeros(len(grams), np.int64)
    alive, i = np.flatnonzero(size > 0), 0
    while len(alive) and i < _LEVELS:
        i += 1
        alive = alive[_hit(bits, start[alive], size[alive], grams[alive], i)]
        out[alive] = i
    return out


def part_of(grams: np.ndarray, levels: np.ndarray, n_bits: int) -> np.ndarray:
    """A part of the filter that holds the n-grams with all their levels."""
    out = np.zeros(n_bits, bool)
    for i in range(1, int(levels.max(initial=0)) + 1):
        for place in _places(grams[levels >= i], i, n_bits):
            out[place.astype(np.int64)] = True
    return np.packbits(out, bitorder="little")


# --- counting -----------------------------------------------------------------

def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _planes(keys: np.ndarray) -> bytes:
    """Sorted numbers, first bytes together, and so on: the upper ones hardly differ, and
    the compression of a shuffle finds that."""
    return np.ascontiguousarray(keys, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _keys(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(U64, copy=False)


def _counts(ranges: int):
    """(range, pairs, keys, counts): what a task's texts hold, a row for each range."""
    def packed(single: list, double: list) -> Iterator[pa.RecordBatch]:
        for kind, parts in ((False, single), (True, double)):
            keys, counts = _added(*(np.concatenate(c) for c in zip(*parts)))
            bounds = np.searchsorted(range_of(keys, ranges), np.arange(ranges + 1))
            rows = [(r, kind, _planes(keys[a:b]), counts[a:b].astype(np.uint32).tobytes())
                    for r, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
            for i in range(0, len(rows), 64):
                columns = list(zip(*rows[i:i + 64]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1]), pa.array(columns[2], pa.binary()),
                     pa.array(columns[3], pa.binary())], ["range", "pairs", "keys", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double, held = [], [], 0
        for batch in batches:
            for _, stream, bounds in tokens(batch.column("text")):
                for parts, keys in ((single, stream), (double, pairs(stream, bounds)[0])):
                    keys = np.sort(keys)
                    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
                    parts.append((keys[first], np.diff(np.concatenate((first, [len(keys)]))).astype(np.int64)))
                held += len(stream)
                if held > TASK_TOKENS:
                    yield from packed(single, double)
                    single, double, held = [], [], 0
        if held:
            yield from packed(single, double)

    return run


def _gathered(batch_rows: pa.Table) -> dict[bool, tuple[np.ndarray, np.ndarray]]:
    out = {}
    kinds = np.asarray(batch_rows.column("pairs"))
    for kind in (False, True):
        rows = batch_rows.filter(pa.array(kinds == kind))
        keys = np.concatenate([np.zeros(0, U64), *map(_keys, rows.column("keys").to_pylist())])
        counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint32).astype(np.int64)
        out[kind] = _added(keys, counts)
    return out


_SUMS = "range int, word long, count long, bits long, part binary"
_SUM_NAMES = [c.split()[0] for c in _SUMS.split(", ")]


def _sums(table: pa.Table) -> pa.Table:
    """Of one range: (word, count) for every word, and the filter of its words and pairs at
    every level. Pairs are needed for nothing else and are not kept."""
    number = table.column("range")[0].as_py()
    found = _gathered(table)
    (words, counts), (grams, times) = found[False], found[True]
    levels = level(np.concatenate((counts, times)))
    bits = max(int(levels.sum()) * ENTRY_BITS // 64 * 64, 64)
    part = part_of(np.concatenate((words, grams)), levels, bits).tobytes()
    rows = len(words)
    return pa.Table.from_arrays([
        pa.array(np.full(rows + 1, number, np.int32)),
        pa.concat_arrays([pa.array(words.astype(np.int64)), pa.nulls(1, pa.int64())]),
        pa.concat_arrays([pa.array(counts.astype(np.int64)), pa.nulls(1, pa.int64())]),
        pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array([bits], pa.int64())]),
        pa.concat_arrays([pa.nulls(rows, pa.binary()), pa.array([part], pa.binary())])], names=_SUM_NAMES)


def learn(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame | None]:
    """The model of all documents that are not held out, (word, count) of them all, and the
    parts of the filter if they are too large for the model."""
    known = docs.where(~held_out(F.col("doc_id"))).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    size, texts = known.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    ranges = max(4, -(-(size or 0) // RANGE_BYTES))
    counted = known.select("text").mapInArrow(_counts(ranges), "range int, pairs boolean, keys binary, counts binary")
    # A range holds about RANGE_BYTES of text, however many there are; a frequent word is
    # one entry of each task.
    sums = written(counted.groupBy("range").applyInArrow(_sums, _SUMS), "lm-counts")
    words = sums.where("word is not null").select("word", "count")
    total, distinct = words.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count("*")).first()
    parts = sums.where("part is not null").select("range", "bits", "part")
    large = (parts.agg(F.sum("bits")).first()[0] or 0) > MOST_BITS
    sizes, start = np.zeros(ranges, np.int64), np.zeros(ranges, np.int64)
    bits, at = np.zeros(1, np.uint8), 0
    if not large:
        # At most MOST_BITS together.
        gathered = parts.toArrow()
        bits = np.zeros(max(1, sum(gathered.column("bits").to_pylist()) // 8), np.uint8)
        for number, n, part in zip(*(gathered.column(c) for c in ("range", "bits", "part"))):
            sizes[number.as_py()], start[number.as_py()] = n.as_py(), at * 8
            part = np.frombuffer(part.as_buffer(), np.uint8)
            bits[at:at + len(part)] = part
            at += len(part)
        del gathered
    # The most frequent words: those from the smallest count on that leaves TOP at most.
    by_count = words.groupBy(F.floor(F.log("count") / np.log(1.1)).alias("step")).count().collect()
    least_step, n = 0, 0
    for row in sorted(by_count, key=lambda r: -r["step"]):
        n += row["count"]
        if n > TOP:
            least_step = row["step"] + 1
            break
    top = words.where(F.floor(F.log("count") / np.log(1.1)) >= least_step).toArrow()
    order = np.argsort(np.asarray(top.column("word")).astype(U64))
    return Model(
        bits, start, sizes, total, distinct, texts, np.asarray(top.column("word")).astype(U64)[order],
        np.asarray(top.column("count"))[order]), words, parts if large else None


# --- scoring ------------------------------------------------------------------

def _terms(model: Model, stream: np.ndarray, bounds: np.ndarray, distinct: tuple, levels):
    """At every token: count of the pair, of the token before, and p of the token."""
    words, at = distinct
    grams, pair_at = np.unique(pairs(stream, bounds)[0], return_inverse=True)
    of_words, of_pairs = levels(words, grams)
    counts = VALUES[of_words]
    single = ((counts + 1.0) / (model.total + model.distinct + 1.0))[at]
    before = np.empty(len(stream))
    before[1:] = counts[at][:-1]
    before[bounds[:-1]] = model.texts
    # A pair is no more frequent than what it begins with.
    return np.minimum(VALUES[of_pairs][pair_at], before), before, single


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, scores array<double>, left_out array<double>, word long, times long"
LIST = pa.list_(pa.float64())
_SCORED_NAMES = [c.split()[0] for c in _SCORED.split(", ")]


def _table(values: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel()))


def _rows(model: Model, part, names: np.ndarray, stream: np.ndarray, bounds: np.ndarray, levels) -> Iterator[pa.RecordBatch]:
    """A row for each text, and rows (row, word, times) for words outside the top. A text has
    its score under each of the priors and, if the model learned from it, the same with each
    of its pairs left out once."""
    n, start, whole = len(bounds) - 1, bounds[:-1], np.log10(model.total + model.distinct + 1.0)
    once, at = np.unique(stream, return_inverse=True)
    both, before, single = _terms(model, stream, bounds, (once, at), levels)
    scores = np.stack([np.add.reduceat(np.log10((both + m * single) / (before + m)), start) for m in PRIORS], 1)
    learned = ~np.asarray(part.column("held_out").cast(pa.uint8())).astype(bool)
    both, before = np.maximum(both - 1, 0), np.maximum(before - 1, 0)
    left_out = np.stack([np.add.reduceat(np.log10((both + m * single) / (before + m)), start) for m in PRIORS], 1)
    known, counts = np.zeros(len(once), bool), np.zeros(len(once))
    if len(model.top):
        place = np.minimum(np.searchsorted(model.top, once), len(model.top) - 1)
        known, counts = model.top[place] == once, model.top_counts[place]
    term, known = np.where(known, np.log10(counts + 1.0) - whole, 0.0)[at], known[at]
    base = np.add.reduceat(term, start)
    yield pa.RecordBatch.from_arrays(
        [pa.array(names), part.column("doc_id").cast(pa.int64()), part.column("held_out"), pa.array(np.diff(bounds)),
         pa.array(np.add.reduceat(known.astype(np.int64), start)), pa.array(base), _table(scores),
         _table(left_out * learned[:, None]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], _SCORED_NAMES)
    owner = np.repeat(names, np.diff(bounds))[~known]
    rare = stream[~known]
    if len(rare):
        order = np.lexsort((rare, owner))
        owner, rare = owner[order], rare[order]
        begin = np.flatnonzero(np.concatenate(([True], (rare[1:] != rare[:-1]) | (owner[1:] != owner[:-1]))))
        times = np.diff(np.concatenate((begin, [len(rare)])))
        blank = [pa.nulls(len(begin), t) for t in (
            pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), LIST, LIST)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(owner[begin]), *blank, pa.array(rare[begin].astype(np.int64)), pa.array(times)], _SCORED_NAMES)


def _scored(held):
    """The rows of all texts by the filter that the model holds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        model, row = held.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for first, stream, bounds in tokens(batch.column("text")):
                n = len(bounds) - 1
                yield from _rows(model, batch.slice(first, n), row + np.arange(n), stream, bounds,
                                 lambda words, grams: (model.levels(words), model.levels(grams)))
                row += n

    return run


# --- scoring by a filter that is too large for a task ----------------------------

def _stream(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of some texts and their bounds."""
    streams, ends = [], [np.zeros(1, np.int64)]
    for _, stream, bounds in tokens(texts.column("text").combine_chunks()):
        streams.append(stream)
        ends.append(bounds[1:] + ends[-1][-1])
    return np.concatenate(streams), np.concatenate(ends)


def _asked(ranges: int):
    """The distinct words and pairs of a chunk of texts for each range."""
    def run(texts: pa.Table) -> pa.Table:
        stream, bounds = _stream(texts)
        grams = [np.unique(stream), np.unique(pairs(stream, bounds)[0])]
        cuts = [np.searchsorted(range_of(g, ranges), np.arange(ranges + 1)) for g in grams]
        used = np.flatnonzero((np.diff(cuts[0]) > 0) | (np.diff(cuts[1]) > 0))
        blobs = [pa.array([_planes(g[c[r]:c[r + 1]]) for r in used], pa.binary()) for g, c in zip(grams, cuts)]
        chunk = pa.array(np.full(len(used), texts.column("chunk")[0].as_py(), np.int64))
        return pa.Table.from_arrays([chunk, pa.array(used.astype(np.int32)), *blobs], names=["chunk", "range", "words", "pairs"])

    return run


def _answered(asked: pa.Table, parts: pa.Table) -> pa.Table:
    """The questions of one range with levels, a byte each, in place of the n-grams."""
    out = []
    for name in ("words", "pairs"):
        blobs = asked.column(name).to_pylist()
        grams = np.concatenate([np.zeros(0, U64), *map(_keys, blobs)])
        if len(parts):
            size = np.full(len(grams), parts.column("bits")[0].as_py(), np.int64)
            bits = np.frombuffer(parts.column("part")[0].as_buffer(), np.uint8)
            levels = levels_in(bits, np.zeros(len(grams), np.int64), size, grams).astype(np.uint8).tobytes()
        else:
            levels = bytes(len(grams))
        ends = np.cumsum([0, *(len(b) // 8 for b in blobs)])
        out.append(pa.array([levels[a:b] for a, b in zip(ends, ends[1:])], pa.binary()))
    return pa.Table.from_arrays(
        [asked.column("chunk").cast(pa.int64()), asked.column("range").cast(pa.int32()), *out], names=["chunk", "range", "words", "pairs"])


def _scored_chunk(held):
    """The rows of a chunk's texts by the answers for it."""
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("range")
        # Ranges follow the hashes, so the answers stand in the order of the n-grams.
        found = [np.frombuffer(b"".join(answers.column(c).to_pylist()), np.uint8).astype(np.int64) for c in ("words", "pairs")]
        stream, bounds = _stream(texts)
        part = texts.combine_chunks().to_batches()[0]
        names = (texts.column("chunk")[0].as_py() << 40) + np.arange(texts.num_rows)
        return pa.Table.from_batches(list(_rows(held.value, part, names, stream, bounds, lambda words, grams: found)))

    return run


def _by_shuffle(texts: DataFrame, held, parts: DataFrame, ranges: int) -> DataFrame:
    """Texts are dealt to chunks by their content, so that a chunk is the same whenever it
    is read; the questions and the scores read one and the same shuffle of them, and
    neither texts nor questions are written."""
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(CHUNKS * ranges)).alias("chunk")
    texts = texts.select(chunk, "doc_id", "held_out", "text").groupBy("chunk")
    questions = texts.applyInArrow(_asked(ranges), "chunk long, range int, words binary, pairs binary")
    answers = questions.groupBy("range").cogroup(parts.groupBy("range")).applyInArrow(
        _answered, "chunk long, range int, words binary, pairs binary")
    return texts.cogroup(answers.groupBy("chunk")).applyInArrow(_scored_chunk(held), _SCORED)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, distinct_tokens."""
    model, words, parts = learn(docs)
    held = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    if parts is None:
        rows = texts.mapInArrow(_scored(held), _SCORED)
    else:
        rows = _by_shuffle(texts, held, parts, len(model.part_bits))
    rows = written(rows, "lm-scored")
    # The prior under which training texts are likeliest, each pair left out once.
    sums = rows.agg(*[F.coalesce(F.sum(F.col("left_out")[i]), F.lit(0.0)) for i in range(len(PRIORS))]).first()
    best = int(np.argmax(list(sums)))
    rare = rows.where("word is not null").select("row", "word", "times").join(words, "word", "left")
    count = F.coalesce("count", F.lit(0))
    whole = float(np.log10(model.total + model.distinct + 1.0))
    rare = rare.groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(count + 1.0) - F.lit(whole))).alias("__base"),
        F.sum(F.when(count > 0, F.col("times")).otherwise(0)).alias("__known"))
    out = rows.where("word is null").drop("word", "times").join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("__known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("__base", F.lit(0.0))).alias("base_score"), F.col("scores")[best].alias("score"),
        F.lit(model.distinct).cast("long").alias("distinct_tokens"))
