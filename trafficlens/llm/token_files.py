"""Token ids as flat binary files with 64-bit document offsets.

Documents are dealt out by ranges of doc_id and sorted, so that part files in their
order hold all documents in ascending doc_id. A task encodes its documents and writes

    part-00012.ids   little-endian unsigned ids, 16 bits wide if the vocabulary fits, else 32
    part-00012.idx   little-endian 64-bit starts of its documents, and the end behind the last
    part-00012.doc   little-endian 64-bit doc_ids (a null doc_id is the smallest number)

under names of its own attempt and renames them, so a repeated task leaves the same
files. Only (part, documents, ids) come back; the id at which a part begins in the whole
corpus is the prefix sum of that small table. Readers map a part into memory and touch
the documents that they want.

Defined results: null is the empty text, with the end id alone; a null doc_id sorts
first; rows of one doc_id follow each other by text; an empty table makes no files.
"""

from __future__ import annotations

import gc
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trafficlens.session import work_path, written

#: UTF-8 bytes of text that go to one part file.
PART_BYTES = 32 << 20
#: Words whose ids a worker keeps (twice as many, as those that came up again stay).
KEPT_WORDS, KEPT_CHARS = 400_000, 64
_NULL = -2**63
#: No token of the vocabulary reaches over white space, so words are encoded alone.
_at_ascii_space = re.compile(r"[^ \t\n\x0b\x0c\r]+").findall
#: What Python's split() takes for white space besides that.
_OTHER_SPACE = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _words(text: str) -> list[str]:
    if any(c in text for c in _OTHER_SPACE):
        return _at_ascii_space(text)
    return text.split()


#: Signs that no token joins with letters or digits; an apostrophe may begin an ending.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
#: Letters for which lower case is all that the library does before its merges.
_letters = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch
#: Runs of letters that are encoded in one call.
TOGETHER = 1000


def _parts(word: str) -> tuple[str, ...]:
    """A word, or what stands before its closing signs and those; case does not count."""
    if word.isalpha() and word.isascii():
        return (word.lower(),)
    stem = word.rstrip(_SIGNS)
    parts = (stem, word[len(stem):]) if stem and len(stem) < len(word) and stem[-1] in _PLAIN else (word,)
    return tuple(p.lower() if p.isascii() or _letters(p) else p for p in parts)


class Encoder:
    """The ids of whole texts as bytes of the file format."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        # Special strings are cut out before words are made, as the library does with raw
        # texts. What remains must not become one, such as <|ENDOFTEXT|> in lower case.
        self.tokenizer.encode_special_tokens = True
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.type = id_type(self.tokenizer.get_vocab_size(with_added_tokens=True))
        self.code = "H" if self.type == "<u2" else "I"
        self.special = {text: np.array([i], self.type).tobytes() for text, i in added.items()}
        # The same merges behind a split at spaces, for runs of letters in lower case. The
        # vocabulary marks the ends of runs, at each run's last id only.
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.merges, self.ends = Tokenizer(self.tokenizer.model), np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if suffix else ():
            self.ends[i] = token.endswith(suffix)
        self.parts: dict[str, bytes] = {}
        self.kept: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, parts: set[str]) -> None:
        if len(self.parts) > KEPT_WORDS:
            self.parts = {p: self.parts[p] for p in parts if p in self.parts}
        parts = parts.difference(self.parts)
        runs = [p for p in parts if _letters(p)]
        for i in range(0, len(runs), TOGETHER):
            self._learn_together(runs[i:i + TOGETHER])
        parts = list(parts.difference(self.parts))
        for part, encoding in zip(parts, self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)):
            self.parts[part] = array(self.code, encoding.ids).tobytes()

    def _learn_together(self, runs: list[str]) -> None:
        """Runs of letters as one text, cut at the ids that end a run. If those are not one
        for each, nothing is learned here."""
        [encoding] = self.merges.encode_batch_fast([" ".join(runs)], add_special_tokens=False)
        ids = np.array(encoding.ids, self.type)
        cuts = ((np.flatnonzero(self.ends[ids]) + 1) * ids.itemsize).tolist()
        if len(cuts) == len(runs) and cuts[-1] == ids.nbytes:
            data = ids.tobytes()
            self.parts.update(zip(runs, [data[a:b] for a, b in zip([0, *cuts], cuts)]))

    def _split(self, text: str) -> list[str]:
        """Words and special strings; no word holds one of those."""
        if not any(s in text for s in self.special):
            return _words(text)
        parts = self.added.split(text)
        return [w for i, part in enumerate(parts) for w in ([part] if i % 2 else _words(part))]

    def encode(self, texts: list[str | None], end: int) -> list[bytes]:
        texts = [self._split(t or "") for t in texts]
        every = set().union(*texts)
        wanted = every.difference(self.kept)
        made = {w: self.older[w] for w in wanted if w in self.older}
        made.update((w, ids) for w, ids in self.special.items() if w in wanted)
        new = [w for w in wanted if w not in made]
        split = [_parts(w) for w in new]
        self._learn(set().union(*split))
        for word, parts in zip(new, split):
            made[word] = self.parts[parts[0]] if len(parts) == 1 else b"".join([self.parts[p] for p in parts])
        if len(self.kept) + len(made) > KEPT_WORDS:
            # The words of these texts go over to the new table.
            made.update((w, self.kept[w]) for w in every.difference(wanted))
            self.older, self.kept = self.kept, {}
        self.kept.update(made)
        last, ids = np.array([end], self.type).tobytes(), self.kept.__getitem__
        out = [b"".join(map(ids, words)) + last for words in texts]
        for word in made:
            if len(word) > KEPT_CHARS:
                del self.kept[word]
        return out


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder, with its kept words, per worker process."""
    if path not in _encoders:
        # The kept tables have no cycles, and the collector would walk them again and again.
        gc.set_threshold(1_000_000, 100, 100)
        _encoders[path] = Encoder(path)
    return _encoders[path]


def id_type(vocabulary: int) -> str:
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _place(folder: str) -> tuple[pafs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder[5:])
    return pafs.LocalFileSystem(), folder


def write(docs: DataFrame, folder: str, path: str, end: int) -> DataFrame:
    """Writes all part files; returns (part, docs, ids, base), one row a file."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    parts = max(1, -(-total // PART_BYTES))
    place = (F.coalesce(F.col("doc_id"), F.lit(_NULL)), F.xxhash64("text"))
    rows = rows.repartitionByRange(parts, *place).sortWithinPartitions(*place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        encoder, (fs, root) = encoder_of(path), _place(folder)
        width = np.dtype(encoder.type).itemsize
        starts, at, files = [0], 0, {}
        name = {kind: f"{root}/part-{part:05d}.{kind}" for kind in ("ids", "idx", "doc")}
        try:
            for batch in batches:
                for i in range(0, batch.num_rows, 500):
                    piece = batch.slice(i, 500)
                    if not files:
                        fs.create_dir(root, recursive=True)
                        files = {k: fs.open_output_stream(f"{n}.{attempt}") for k, n in name.items()}
                    for ids in encoder.encode(piece.column("text").to_pylist(), end):
                        files["ids"].write(ids)
                        at += len(ids) // width
                        starts.append(at)
                    keys = piece.column("doc_id").cast(pa.int64()).fill_null(_NULL)
                    files["doc"].write(np.asarray(keys).astype("<i8").tobytes())
                    if len(starts) > 100_000:
                        files["idx"].write(np.array(starts[:-1], "<i8").tobytes())
                        del starts[:-1]
            if files:
                files["idx"].write(np.array(starts, "<i8").tobytes())
        finally:
            for file in files.values():
                file.close()
        if files:
            for k, n in name.items():
                fs.move(f"{n}.{attempt}", n)
            n_docs = fs.get_file_info(name["doc"]).size // 8
            yield pa.RecordBatch.from_pydict({"part": [part], "docs": [n_docs], "ids": [at]})

    made = written(rows.mapInArrow(run, "part long, docs long, ids long"), "token-parts")
    # One row a file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def _mapped(fs: pafs.FileSystem, name: str, kind: str) -> np.ndarray:
    """A whole file as an array: mapped where the folder is mounted, else read."""
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(name, kind, "r")
    with fs.open_input_file(name) as file:
        return np.frombuffer(file.read(), kind)


def read(parts: DataFrame, folder: str, vocabulary: int, columns: str, use) -> DataFrame:
    """``use(doc_id, start, ids)`` for every document of the files, as rows of ``columns``.

    Parts are dealt out to tasks by number; each is mapped and read document by document.
    """
    names = [c.split()[0] for c in columns.split(", ")]
    kind = id_type(vocabulary)

    def run(batches):
        fs, root = _place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name = f"{root}/part-{row['part']:05d}"
                starts, keys = _mapped(fs, name + ".idx", "<i8"), _mapped(fs, name + ".doc", "<i8")
                ids = _mapped(fs, name + ".ids", kind)
                for first in range(0, len(keys), 2000):
                    out = [use(None if keys[i] == _NULL else int(keys[i]), row["base"] + int(starts[i]),
                               ids[starts[i]:starts[i + 1]]) for i in range(first, min(first + 2000, len(keys)))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    return parts.repartition(F.col("part")).mapInArrow(run, columns)


def _digest(doc_id, start, ids):
    return doc_id, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))


def round_trip(spark: SparkSession, docs: DataFrame, path: str, vocabulary: int, end: int = 1) -> DataFrame:
    """Writes the corpus and reads it back: doc_id, start, n_tokens, ids_crc32."""
    folder = work_path(spark, f"tokens-{uuid.uuid4().hex[:8]}")
    parts = write(docs, folder, path, end)
    return read(parts, folder, vocabulary, "doc_id long, start long, n_tokens long, ids_crc32 long", _digest)
