"""Token counts of whole texts, huge ones by overlapping chunks that are spliced.

A text of ordinary size is counted by the tokenizer library. A huge one is cut into
overlapping chunks, each a row of its own that any task may encode, with offsets. Two
neighbours are spliced at a place of their overlap that is proven to be a border of the
encoding of the whole text; the count is then the sum of what lies between the borders.

Borders between words. The library splits a text into words from left to right; what it
does from a border on depends only on the text behind it. The left chunk is true from its
own splice on, except near its end, where a word or a special string may be cut. So a
border that the left chunk has before its last ``margin`` characters is one of the whole
text, and if the right chunk has it too, it is true from there on.

Borders inside a word. Where one word fills the overlap (a run of letters, digits, signs
or blanks), a token border of both chunks is one of the whole text if the merges leave
the two tokens beside it as they are when these stand alone: tokens of a word are right
exactly if each two neighbours are.

Where an overlap holds no such place, the document is cut anew with longer overlaps,
until it is one chunk in the end.

Special strings in a text are tokens, as the library has it by default; nothing is added,
cut or padded. Tokenizers for which the proof does not hold are refused.

Nulls and odd cases: null is the empty text and has no tokens; rows that are alike are
counted each, though a huge text is encoded once however often it occurs; a text of one
endless word costs more rounds, not another result; an empty table gives an empty table;
columns named as the new ones are replaced.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trafficlens.llm.tables import text_of
from trafficlens.session import BROADCAST_BYTES, Scratch, stored_bytes

#: Characters from one chunk's start to the next, and by which chunks overlap at first.
STEP, OVERLAP = 1 << 15, 512
#: How much longer overlaps become where two chunks do not align.
WIDER = 8
#: Characters of texts that the library takes at once.
BATCH_CHARS = 1 << 20
#: Characters behind a border that decide it: "'ll", or a blank and what follows.
LOOKAHEAD = 3


class Counter:
    """The library's encoder, with what the splices have to know about it."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        settings = json.loads(self.tokenizer.to_str())
        split, added, model = settings["pre_tokenizer"] or {}, settings["added_tokens"], settings["model"]
        wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        self.spliced = (
            settings["normalizer"] is None and settings["post_processor"] is None and split | wanted == split
            and model["type"] == "BPE"
            and not any(model.get(k) for k in ("dropout", "ignore_merges", "end_of_word_suffix", "continuing_subword_prefix"))
            and not any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in added))
        self.margin = max([len(a["content"]) for a in added], default=0) + LOOKAHEAD

    def count(self, texts: list[str]) -> list[int]:
        out, at = [], 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= BATCH_CHARS):
                size, end = size + len(texts[end]), end + 1
            out += map(len, self.tokenizer.encode_batch_fast(texts[at:end], add_special_tokens=False))
            at = end
        return out

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def stand(self, left: str, right: str) -> bool:
        """Whether two tokens stay as they are beside each other."""
        found = self.encode(left + right)
        return found.offsets == [(0, len(left)), (len(left), len(left) + len(right))] and found.word_ids == [0, 0]


_counters: dict[str, Counter] = {}


def counter_of(path: str) -> Counter:
    """One encoder per worker process."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def chunks(text: str, step: int, overlap: int) -> Iterator[tuple[int, str, bool]]:
    """(number, chunk, whether it is the last)."""
    last = max(0, -(-(len(text) - overlap) // step) - 1)
    for i in range(last + 1):
        yield i, text[i * step:] if i == last else text[i * step:(i + 1) * step + overlap], i == last


#: What a chunk knows about an overlap: places (from the overlap's start), tokens before
#: each, and, if one word fills the overlap, the token at each place.
SIDE = "at array<int>, before array<long>, token array<string>"


def _side(text: str, found, start: int, end: int, left: bool, margin: int) -> dict:
    """The borders of a chunk's encoding from ``start`` to ``end``; ``left``: the chunk
    goes before the overlap, so it is cut at its end."""
    offsets, words = found.offsets, found.word_ids
    inner = range(max(bisect_left(offsets, (start, start)), 1), bisect_left(offsets, (end, end)))
    at, before, token = [], [], []
    if left:
        filled = offsets[found.word_to_tokens(words[-1])[0]][0] < start
    else:
        filled = offsets[found.word_to_tokens(words[0])[1] - 1][1] >= end
        if not filled:
            at, before = [0], [0]
    for i in inner:
        place = offsets[i][0]
        if filled:
            if offsets[i - 1][1] == place:
                near = offsets[i - 1] if left else offsets[i]
                at.append(place - start), before.append(i), token.append(text[near[0]:near[1]])
        elif words[i] != words[i - 1] and not (left and place > end - margin):
            at.append(place - start), before.append(i)
    return {"at": at, "before": before, "token": token if filled else None}


def sides(counter: Counter, number: int, text: str, last: bool, step: int, overlap: int) -> Iterator[dict]:
    """What a chunk adds to the seams at its two ends; the last one ends with its count."""
    found = counter.encode(text)
    if number:
        yield {"seam": number, "left": False, **_side(text, found, 0, overlap, False, counter.margin)}
    if last:
        yield {"seam": number + 1, "left": True, "at": [-1], "before": [len(found)], "token": None}
    else:
        yield {"seam": number + 1, "left": True, **_side(text, found, step, step + overlap, True, counter.margin)}


def splice(counter: Counter, left: dict, right: dict | None) -> int | None:
    """Tokens that a seam adds: those of the left chunk before the common border, less
    those of the right chunk before it; None if no place is proven."""
    if right is None:
        return left["before"][0]
    if (left["token"] is None) != (right["token"] is None):
        return None
    places = {place: i for i, place in enumerate(right["at"])}
    for i, place in enumerate(left["at"]):
        j = places.get(place)
        if j is not None and (left["token"] is None or counter.stand(left["token"][i], right["token"][j])):
            return left["before"][i] - right["before"][j]
    return None


def _round(docs: DataFrame, path: str, step: int, overlap: int) -> DataFrame:
    """(key, n_tokens) of documents (key, text); null where chunks did not align."""

    def cut(batches):
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text")):
                made = list(chunks(text.as_py(), step, overlap))
                for i in range(0, len(made), 64):
                    number, piece, last = zip(*made[i:i + 64])
                    yield pa.RecordBatch.from_pydict(
                        {"key": [key] * len(piece), "number": pa.array(number, pa.int32()), "piece": list(piece), "last": list(last)})

    def encode(batches):
        counter = counter_of(path)
        schema = pa.schema([("key", pa.string()), ("seam", pa.int32()), ("left", pa.bool_()), ("at", pa.list_(pa.int32())),
                            ("before", pa.list_(pa.int64())), ("token", pa.list_(pa.string()))])
        for batch in batches:
            for i in range(batch.num_rows):
                key, number, last, piece = (batch.column(c)[i].as_py() for c in ("key", "number", "last", "piece"))
                rows = [{"key": key, **side} for side in sides(counter, number, piece, last, step, overlap)]
                yield pa.RecordBatch.from_pylist(rows, schema)

    def join(batches):
        counter = counter_of(path)
        for batch in batches:
            made = [splice(counter, row["l"], row["r"]) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(made, pa.int64())], ["key", "n"])

    pieces = docs.mapInArrow(cut, "key string, number int, piece string, last boolean")
    # Copies of a text make the same chunks; one of each is encoded, wherever it lies.
    pieces = pieces.groupBy("key", "number").agg(F.first("last").alias("last"), F.first("piece").alias("piece"))
    seams = pieces.mapInArrow(encode, f"key string, seam int, left boolean, {SIDE}").withColumn("side", F.struct("at", "before", "token"))
    seams = seams.groupBy("key", "seam").agg(
        F.first(F.when(F.col("left"), F.col("side")), ignorenulls=True).alias("l"),
        F.first(F.when(~F.col("left"), F.col("side")), ignorenulls=True).alias("r"))
    return seams.select("key", "l", "r").mapInArrow(join, "key string, n long").groupBy("key").agg(
        F.when(F.count("n") == F.count("*"), F.sum("n")).alias("n_tokens"))


def _huge(docs: DataFrame, path: str, step: int, overlap: int, scratch: Scratch) -> list[DataFrame]:
    """(key, n_tokens) of distinct texts (key, text), in rounds of growing overlap."""
    done = []
    while True:
        made = scratch.written(_round(docs, path, max(step, overlap), overlap), "token-counts")
        done.append(made.where("n_tokens IS NOT NULL"))
        left = made.where("n_tokens IS NULL").select("key")
        if left.isEmpty():
            return done
        docs, overlap = docs.join(left, "key", "left_semi"), overlap * WIDER


def count_tokens(docs: DataFrame, path: str, text: str = "text", step: int = STEP, overlap: int = OVERLAP) -> DataFrame:
    """The documents without their text, with n_bytes and n_tokens."""
    counter = counter_of(path)
    if not counter.spliced or overlap <= counter.margin or step < overlap:
        raise ValueError("needs byte-level BPE without normalizer, and step >= overlap > its longest special string")
    kept = [c for c in docs.columns if c not in (text, "n_bytes", "n_tokens")]
    rows = docs.select(*kept, F.octet_length(text_of(text)).cast("long").alias("n_bytes"), text_of(text).alias("__text"))
    is_huge = F.char_length("__text") > step + overlap
    schema = rows.select(*kept, "n_bytes").schema.add("n_tokens", "long")

    def run(batches):
        counter = counter_of(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                made = counter.count(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in (*kept, "n_bytes")), pa.array(made, pa.int64())], [*kept, "n_bytes", "n_tokens"])

    whole = rows.where(~is_huge).mapInArrow(run, schema)
    keyed = rows.where(is_huge).withColumn("__key", F.sha2(F.encode("__text", "UTF-8"), 256))
    if keyed.isEmpty():
        return whole
    scratch = Scratch()
    found = _huge(keyed.select(F.col("__key").alias("key"), F.col("__text").alias("text")), path, step, overlap, scratch)
    counts = found[0]
    for more in found[1:]:
        counts = counts.union(more)
    lasting = Scratch()
    counts = lasting.written(counts.select(F.col("key").alias("__key"), "n_tokens"), "token-counts-of-huge")
    scratch.clear()
    if stored_bytes(docs.sparkSession, lasting.paths[0]) <= BROADCAST_BYTES:
        counts = F.broadcast(counts)
    return whole.union(keyed.drop("__text").join(counts, "__key").select(*kept, "n_bytes", "n_tokens"))
