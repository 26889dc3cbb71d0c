"""Phrase collocations: sticky word sequences of each language.

Counting. A text is cut at punctuation into pieces and those into words. Every word
begins one window of the longest length, made by lead columns over its piece; a window
that would pass the end of its piece is padded with empty words. Only these windows are
counted: ``ROLLUP`` over their word columns sums them up to ever shorter prefixes, and as
each occurrence of a phrase begins exactly one window, the sum at a prefix is the count
of that phrase. No n-grams of several lengths are made from the text.

Windows are counted within chunks of texts, then sorted over ranges, so that no word or
language meets in one task. In that order, windows too rare to matter are padded down to
the prefix that may matter, which changes no sum of a phrase seen often enough; what
``ROLLUP`` shuffles is small, and so is everything after it.

Scores. A phrase seen a times is cut after its first k words into parts seen l and r
times; a*a/(l*r), in millionths and rounded down, is its score at that cut, and the
lowest cut counts. The arithmetic is decimal and exact.

Nulls and odd cases: a null text has no words; a null language is ``und`` and joins
documents of that name; a piece shorter than a phrase does not hold it; repeated rows
count repeatedly; ties in score are ordered by count, then by the phrase's bytes; an
empty table gives an empty table; only ``lang`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from trafficlens.llm.tables import text_of
from trafficlens.session import BROADCAST_BYTES, Scratch, stored_bytes, written

#: Punctuation and line ends that no phrase crosses; blanks between words.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
_END, _BLANK = b"\n "
_line = re.compile(r"\\(.)")
_FOLD = bytes.maketrans(
    ascii_uppercase.encode() + PIECE_ENDS + BLANKS,
    ascii_lowercase.encode() + b"\n" * len(PIECE_ENDS) + b" " * len(BLANKS))
#: Longest phrase in words, occurrences a phrase needs, per cent of its occurrences that
#: a longer phrase must cover to replace it, phrases returned per language.
LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Candidates of a language that one task ranks before the languages' best meet.
RANKED_ROWS = 1 << 20
#: Bytes of text whose windows are counted together before they are shuffled, languages
#: of which a task holds such a chunk at once, and rows handed on at a time.
CHUNK_BYTES, LANGUAGES, BATCH_ROWS = 4 << 20, 16, 1 << 16
#: Sorted windows that are folded at once.
FOLD_ROWS = 1 << 18


def _names(longest: int) -> list[str]:
    return [f"w{i + 1}" for i in range(longest)]


def _columns(text: bytes, longest: int) -> tuple[pa.Array, list[np.ndarray]]:
    """The words of folded text, the empty one first, and its windows as lead columns of
    word numbers."""
    data = np.frombuffer(text, np.uint8)
    inside = (data != _BLANK) & (data != _END)
    edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
    listed = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    coded = listed.dictionary_encode()
    words = pa.concat_arrays([pa.array([""]), coded.dictionary])
    column = np.asarray(coded.indices).astype(np.int64) + 1
    piece = np.cumsum(data == _END)[starts] if len(starts) else starts
    columns = [column]
    for i in range(1, longest):
        lead = np.zeros_like(column)
        lead[:-i] = np.where(piece[i:] == piece[:-i], column[i:], 0)
        columns.append(lead)
    return words, columns


def _counted(columns: list[np.ndarray], n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Equal rows once, with their number."""
    key, bound = columns[0], n_words
    for column in columns[1:]:
        if bound * n_words >= 1 << 62:
            _, key = np.unique(key, return_inverse=True)
            bound = len(key)
        key, bound = key * n_words + column, bound * n_words
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return [c[first] for c in columns], counts


class _Buffer:
    """Folded texts of one language, up to ``CHUNK_BYTES``. Where a longer text is cut
    inside a piece, its last words wait for those that follow them."""

    def __init__(self, lang: str, longest: int):
        self.lang, self.longest, self.parts, self.size = lang, longest, [], 0

    def add(self, text: bytes) -> Iterator[pa.RecordBatch]:
        at = 0
        while at < len(text):
            room = max(CHUNK_BYTES - self.size, 1)
            cut = len(text)
            if cut - at > room:
                # Behind the word that stands there.
                ends = (text.find(b" ", at + room), text.find(b"\n", at + room))
                cut = min([x + 1 for x in ends if x >= 0], default=cut)
            self.parts.append(text[at:cut])
            self.size, at = self.size + cut - at, cut
            if at < len(text):
                yield from self.flush()
        self.parts.append(b"\n")
        self.size += 1
        if self.size >= CHUNK_BYTES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        text = b"".join(self.parts)
        self.parts, self.size = [], 0
        words, columns = _columns(text, self.longest)
        if text and text[-1] == _BLANK:
            # The piece goes on: windows of its last words are made with the next chunk.
            piece = text[text.rfind(b"\n") + 1:]
            wait = min(self.longest - 1, len(piece.rsplit(None, self.longest - 1)))
            kept = len(columns[0]) - wait
            self.parts = [w.encode() + b" " for w in words.take(pa.array(columns[0][kept:])).to_pylist()]
            self.size = sum(map(len, self.parts))
            columns = [c[:kept] for c in columns]
        columns, counts = _counted(columns, len(words))
        for i in range(0, len(counts), BATCH_ROWS):
            part = slice(i, i + BATCH_ROWS)
            first, *rest = [words.take(pa.array(c[part])) for c in columns]
            gram = pc.binary_join_element_wise(first, pa.scalar(self.lang), *rest, "\n")
            yield pa.RecordBatch.from_arrays([gram, pa.array(counts[part])], ["gram", "n"])


def windows(docs: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(gram, n): windows of ``longest`` words and how often they occur in a chunk of
    texts; every word begins one, with the words after it in its piece. ``gram`` holds
    first word, language and further words as lines."""

    def run(batches):
        buffers: dict[str, _Buffer] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text").cast(pa.binary())):
                lang = lang.as_py()
                if lang not in buffers:
                    if len(buffers) >= LANGUAGES:
                        for buffer in buffers.values():
                            yield from buffer.flush()
                        buffers.clear()
                    buffers[lang] = _Buffer(lang, longest)
                yield from buffers[lang].add(text.as_py().translate(_FOLD))
        for buffer in buffers.values():
            yield from buffer.flush()

    # No line end inside a language's name.
    lang = F.replace(F.replace(F.coalesce("lang", F.lit("und")), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return docs.select(lang.alias("lang"), text_of().alias("text")).mapInArrow(run, "gram string, n long")


def _changes(column: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; the first one does."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        out[1:] = np.asarray(pc.not_equal(column[1:], column[:-1]))
    return out


def _folded(gram: pa.Array, n: np.ndarray, longest: int, least: int) -> tuple[list[pa.Array], np.ndarray]:
    """Sorted windows to the few that matter, as lang, w1, w2, ..., and their counts: a
    phrase seen fewer than ``least`` times counts with its prefix, padded. Every phrase
    seen so often keeps its count. The first and the last phrase of each length may go
    on before or behind these rows and are left as they are."""
    width = longest + 1
    fields = pc.list_flatten(pc.split_pattern(gram, "\n"))
    first, lang, *rest = [fields.take(pa.array(np.arange(i, len(fields), width))) for i in range(width)]
    words, lang = [first, *rest], lang.dictionary_encode()
    # groups[k]: which prefix of k words a row has.
    fresh = _changes(first) | _changes(lang.indices)
    groups = [np.asarray(lang.indices).astype(np.int64)]
    for column in [None, *rest]:
        fresh = fresh if column is None else fresh | _changes(column)
        groups.append(np.cumsum(fresh) - 1)
    # How many words of a row are still told apart.
    depth = sum(np.asarray(pc.not_equal(w, "")).astype(np.int64) for w in words)
    for k in range(longest, 0, -1):
        group = groups[k]
        few = np.bincount(group, n) < least
        few[[0, -1]] = False
        depth[(depth == k) & few[group]] = k - 1
    place = np.choose(depth, groups) * width + depth
    _, rows, at = np.unique(place, return_index=True, return_inverse=True)
    counts = np.bincount(at, n).astype(np.int64)
    out = [pa.array([_line.sub(lambda m: "\n" if m[1] == "n" else m[1], x) for x in lang.dictionary.to_pylist()]).take(lang.indices.take(pa.array(rows)))]
    for k, column in enumerate(words):
        out.append(pc.if_else(pa.array(depth[rows] > k), column.take(pa.array(rows)), ""))
    return out, counts


def folded(sorted_windows: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, w1, w2, ..., n) of windows sorted within partitions, see ``_folded``."""
    names = ["lang", *_names(longest), "n"]

    def run(batches):
        waiting, rows = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                waiting.append(batch)
                rows += batch.num_rows
            if rows and (batch is None or rows >= FOLD_ROWS):
                table = pa.Table.from_batches(waiting).combine_chunks()
                waiting, rows = [], 0
                columns, counts = _folded(table["gram"].chunk(0), np.asarray(table["n"]), longest, least)
                for i in range(0, len(counts), BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays([c[i:i + BATCH_ROWS] for c in (*columns, pa.array(counts))], names)

    columns = ", ".join(f"{c} string" for c in names[:-1])
    return sorted_windows.mapInArrow(run, f"{columns}, n long")


def frequent(docs: DataFrame, scratch: Scratch, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, words, f): how often each phrase of up to ``longest`` words occurs, where it
    does so ``least`` times; the empty phrase stands for all words of a language."""
    names = ", ".join(_names(longest))
    ordered = windows(docs, longest).repartitionByRange("gram").sortWithinPartitions("gram")
    counted = scratch.written(folded(ordered, longest, least), "phrase-windows")
    rolled = docs.sparkSession.sql(
        f"SELECT lang, {names}, bit_count(grouping_id()) AS rolled, sum(n) AS f FROM {{counted}} "
        f"GROUP BY lang, ROLLUP ({names}) HAVING sum(n) >= {least}", counted=counted)
    # A prefix of i words has the columns behind them rolled up.
    words = F.slice(F.array(*_names(longest)), F.lit(1), F.lit(longest) - F.col("rolled"))
    return rolled.select("lang", words.alias("words"), "f").where(~F.array_contains("words", ""))


def _joined(words: Column) -> Column:
    return F.array_join(words, " ")


def _whole(column: str) -> Column:
    return F.col(column).cast("decimal(18,0)")


def scored(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """Phrases (lang, phrase, words, f) with l, r and score of their lowest cut."""
    part = F.col("k")
    cuts = grams.where(F.size("words") > 1).select(
        "*", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")).select(
        "lang", "phrase", "words", "f", "k", _joined(F.slice("words", F.lit(1), part)).alias("left"),
        _joined(F.slice("words", part + 1, F.size("words") - part)).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    # Counts of up to 15 digits fit; the score is at most a million.
    cuts = cuts.withColumns({"squared": _whole("f") * _whole("f"), "apart": _whole("l") * _whole("r")}).withColumn(
        "score", F.expr("CAST(1000000 AS DECIMAL(7,0)) * CAST(squared AS DECIMAL(31,0)) DIV apart"))
    lowest = F.min(F.struct("score", "k", "l", "r", "f"))
    return cuts.groupBy("lang", "phrase").agg(lowest.alias("cut")).select(
        "lang", "phrase", F.col("cut.f").alias("a"), "cut.l", "cut.r", "cut.score")


def covered(grams: DataFrame, share: int = COVERED) -> DataFrame:
    """(lang, phrase): those that lie inside a longer phrase as often as ``share`` says."""
    size = F.size("words")
    longer = grams.where(size > 2).select(
        "lang", "words", F.col("f").alias("longer"), F.explode(F.sequence(F.lit(2), size - 1)).alias("n")).select(
        "*", F.explode(F.sequence(F.lit(1), size - F.col("n") + 1)).alias("first"))
    inside = longer.groupBy("lang", _joined(F.slice("words", F.col("first"), F.col("n"))).alias("phrase")).agg(
        F.max("longer").alias("longer"))
    return inside.join(grams.select("lang", "phrase", "f"), ["lang", "phrase"]).where(
        _whole("longer") * 100 >= _whole("f") * share).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = COVERED, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of every language."""
    scratch = Scratch()
    grams = scratch.written(
        frequent(docs, scratch, longest, least).withColumn("phrase", _joined(F.col("words"))), "phrase-counts")
    counts = scratch.written(
        grams.where(F.size("words").between(1, longest - 1)).select("lang", "phrase", "f"), "phrase-parts")
    if stored_bytes(docs.sparkSession, scratch.paths[-1]) <= BROADCAST_BYTES:
        counts = F.broadcast(counts)
    good = scratch.written(
        scored(grams, counts).join(covered(grams.where(F.size("words") > 1), share), ["lang", "phrase"], "left_anti"),
        "phrase-scores")
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    # The best of every part of a language first, so that no task ranks a whole language.
    parts = max(1, -(-good.count() // RANKED_ROWS))
    if parts > 1:
        part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(parts))).orderBy(*best)
        good = good.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    ranked = good.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(
        F.col("rank") <= top)
    totals = grams.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    result = written(
        ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "phrases")
    scratch.clear()
    return result


#: The same with all n-grams listed, for whole tables.
ORACLE_SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
    translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
listed AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, unnest(flatten([[w[i:i + s - 1] FOR i IN range(1, greatest(len(w) - s + 2, 1))]
    FOR s IN range(1, {LONGEST + 1})])) AS words
  FROM listed),
counted AS (SELECT lang, words, count(*)::HUGEINT AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE len(words) = 1 GROUP BY lang),
candidates AS (SELECT * FROM counted WHERE len(words) > 1 AND f >= {LEAST}),
cuts AS (
  SELECT c.lang, c.words, c.f AS a, k, x.f AS l, y.f AS r, 1000000 * c.f * c.f // (x.f * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(words))) AS k FROM candidates) c
  JOIN counted x ON x.lang = c.lang AND x.words = c.words[1:k]
  JOIN counted y ON y.lang = c.lang AND y.words = c.words[k + 1:]),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, words ORDER BY score, k) = 1),
inside AS (
  SELECT lang, unnest([words[1:2], words[2:3]]) AS words, f FROM candidates WHERE len(words) = 3),
dropped AS (
  SELECT DISTINCT c.lang, c.words FROM candidates c JOIN inside i ON i.lang = c.lang AND i.words = c.words
  WHERE 100 * i.f >= {COVERED} * c.f),
ranked AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, l, r, score,
    row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank
  FROM lowest ANTI JOIN dropped USING (lang, words))
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
