"""Byte-level BPE by a lazily determinised finite-state transducer, and its decoder.

Encoding. After any prefix of a piece of text the merges give one token sequence, and a
sequence is the result of the merges exactly if every two neighbours are what the merges
make of their joined bytes. So tokens can be read left to right by a transducer: it
follows, at once, every token that may still be growing (a place in the prefix tree of
the vocabulary) together with the token that would stand before it. Such a set is one
deterministic state. States and their byte transitions are made when they are first
needed and kept. Of what stands before a growing token a state holds the last token only,
so it stays bounded on a piece of any length and the same one serves many pieces. Each
move names the token that the prefix ends with there; from the end of the piece these
lead back over its tokens.

Decoding. Token bytes pass an incremental UTF-8 state machine that keeps the bytes of an
unfinished character between chunks.

Defined results: null is the empty text and has no ids; invalid UTF-8 from ids decodes
to replacement characters, while ``decode_bytes`` gives the bytes themselves.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from trafficlens.llm.kept import once

#: Pieces whose result is kept in a worker (twice as many, as those that came up again
#: stay), and bytes of a piece that is kept. Results do not depend on it.
KEPT_PIECES, KEPT_BYTES = 250_000, 64
#: States and neighbour verdicts kept; beyond that they are made anew.
KEPT_STATES, KEPT_VERDICTS = 80_000, 300_000
#: Ids that the decoder takes at once.
DECODE_IDS = 1 << 14


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Token ids of one piece of bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        # The prefix tree: an edge is (node + byte) to (node below, token that ends there
        # or -1, whether longer tokens go on); nodes are multiples of 256, the root is 0.
        below: dict[int, int] = {}
        ends: dict[int, int] = {}
        inner = set()
        # Only tokens that the merges can make of their own bytes are ever read.
        for token, rank in ranks.items():
            if self.merged(token) != [rank]:
                continue
            node = 0
            for byte in token:
                inner.add(node)
                node = below.setdefault(node + byte, (len(below) + 1) << 8)
            ends[node] = rank
        self.tree = {edge: (node, ends.get(node, -1), node in inner) for edge, node in below.items()}
        self.verdicts: dict[int, bool] = {}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.ends_of: dict[int, list[tuple[bytes, int]]] = {}
        self.starts_of: dict[int, list[tuple[bytes, int]]] = {}
        self._clear()

    def _clear(self) -> None:
        # A state is a tuple of (tree node, the token that stands before it or nothing); the
        # last one is at the root and holds the token that the prefix ends with. States
        # are multiples of 256, and a move goes from (state + byte).
        start = ((0, ()),)
        self.states = [start]
        self.number = {start: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def merged(self, data: bytes, below: int | None = None) -> list[int]:
        """The merges in their order (those below a rank), on a few bytes: the
        definition of the encoding."""
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(((self.ranks.get(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))
                        if a + b in self.ranks), default=None)
            if best is None or below is not None and best[0] >= below:
                break
            i = best[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens of a token's last merge; None for a single byte."""
        data = self.tokens[token]
        parts = self.merged(data, token)
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _edge(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at one end of a token while it is made (side 0: its left end):
        the bytes of each stage, and the rank of the merge that ends the stage."""
        out, until = [], len(self.ranks) + 1
        while True:
            out.append((self.tokens[token], until))
            parts = self.parts.get(token, 0)
            if parts == 0:
                parts = self.parts[token] = self._parts(token)
            if parts is None:
                return out
            until, token = token, parts[side]

    def stand(self, left: int, right: int) -> bool:
        """Whether the merges leave these two tokens as neighbours: no stage of the left
        one's right end and of the right one's left end merge before either is merged
        inside its own token. Of equal ranks the pair further left comes first."""
        if len(self.verdicts) >= KEPT_VERDICTS:
            self.verdicts.clear()
        if left not in self.ends_of:
            self.ends_of[left] = self._edge(left, 1)
        if right not in self.starts_of:
            self.starts_of[right] = self._edge(right, 0)
        verdict = self._apart(self.ends_of[left], self.starts_of[right])
        self.verdicts[left << 32 | right] = verdict
        return verdict

    def _apart(self, ends: list[tuple[bytes, int]], starts: list[tuple[bytes, int]]) -> bool:
        rank = self.ranks.get
        for a, a_until in ends:
            for b, b_until in starts:
                joined = rank(a + b)
                if joined is not None and joined < a_until and joined <= b_until:
                    return False
        return True

    def _move(self, step: int) -> tuple[int, int]:
        # Alternatives stand in the order of where their growing token starts. Of the
        # tokens that end here, exactly one goes with what stands before it.
        grown, whole, tree, known = [], -1, self.tree.get, self.verdicts.get
        byte = step & 255
        for node, pending in self.states[step >> 8]:
            edge = tree(node + byte)
            if edge is None:
                continue
            node, token, longer = edge
            if whole < 0 <= token:
                verdict = True
                for before in pending:
                    verdict = known(before << 32 | token)
                    if verdict is None:
                        verdict = self.stand(before, token)
                if verdict:
                    whole = token
            if longer:
                grown.append((node, pending))
        grown.append((0, (whole,)))
        made = tuple(grown)
        number = self.number.get(made)
        if number is None:
            number = self.number[made] = len(self.states) << 8
            self.states.append(made)
        move = self.moves[step] = number, whole
        return move

    def _end(self, step: int) -> int:
        """The token that the piece ends with; no state is made for what does not go on."""
        move = self.moves.get(step)
        if move is not None:
            return move[1]
        tree, known, byte = self.tree.get, self.verdicts.get, step & 255
        for node, pending in self.states[step >> 8]:
            edge = tree(node + byte)
            if edge is None or edge[1] < 0:
                continue
            verdict, token = True, edge[1]
            for before in pending:
                verdict = known(before << 32 | token)
                if verdict is None:
                    verdict = self.stand(before, token)
            if verdict:
                return token
        raise AssertionError("a single byte always stands")

    def encode(self, piece: bytes) -> list[int]:
        if not piece:
            return []
        if len(self.states) >= KEPT_STATES:
            self._clear()
        state, moves, last = 0, self.moves, []
        for byte in piece[:-1]:
            try:
                state, token = moves[state + byte]
            except KeyError:
                state, token = self._move(state + byte)
            last.append(token)
        last.append(self._end(state + piece[-1]))
        # Back from the end: each prefix names the token it ends with.
        out, at, tokens = [], len(last), self.tokens
        while at:
            token = last[at - 1]
            out.append(token)
            at -= len(tokens[token])
        out.reverse()
        return out


class Encoder:
    """Ids of whole texts: pieces by a pattern, each through the transducer."""

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(load_ranks(path))
        self.find = regex.compile(pattern.replace(r"\s", r"\p{White_Space}")
                                  .replace(r"\S", r"\P{White_Space}")).findall
        self.kept: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode("utf-8", "surrogatepass")
            ids = tuple(self.transducer.encode(data))
            if len(data) > KEPT_BYTES:
                return ids
        if len(self.kept) >= KEPT_PIECES:
            self.older, self.kept = self.kept, {}
        self.kept[piece] = ids
        return ids

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        for piece in self.find(text or ""):
            out += self.kept.get(piece) or self._piece(piece)
        return out


class Utf8:
    """Bytes to text, a chunk at a time; an unfinished character waits for the next."""

    def __init__(self):
        self.waiting = b""

    def feed(self, chunk: bytes, last: bool = False) -> str:
        data = self.waiting + chunk
        cut = len(data) if last else len(data) - self._unfinished(data)
        self.waiting = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """Bytes at the end that a further byte could complete to one character."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte & 0xC0 != 0x80:
                need = 4 if 0xF0 <= byte <= 0xF4 else 3 if byte >= 0xE0 and byte < 0xF0 else 2 if 0xC2 <= byte < 0xE0 else 1
                return back if back < need else 0
        return 0


class Decoder:
    def __init__(self, path: str):
        self.tokens = {rank: token for token, rank in load_ranks(path).items()}

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def decode(self, ids: Sequence[int]) -> Iterator[str]:
        """The text of the ids in pieces, as they come."""
        machine = Utf8()
        for i in range(0, len(ids), DECODE_IDS):
            yield machine.feed(self.decode_bytes(ids[i:i + DECODE_IDS]))
        yield machine.feed(b"", last=True)


def _arrays(made: list[list[int]]) -> pa.Array:
    bounds = np.concatenate(([0], np.cumsum([len(x) for x in made])))
    values = np.concatenate([np.zeros(0, np.int32), *(np.array(x, np.int32) for x in made)])
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int32()))


def _decoded_sha256(decoder: Decoder, ids: Sequence[int]) -> str:
    out = hashlib.sha256()
    for piece in decoder.decode(ids):
        out.update(piece.encode("utf-8"))
    return out.hexdigest()


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """The documents without their text, with ids, n_tokens, and the sha256 of what the
    ids decode to; columns of these names are replaced."""
    new = ("ids", "n_tokens", "decoded_sha256")
    kept = [c for c in docs.columns if c not in (text, *new)]
    schema = docs.select(*kept).schema.add("ids", ArrayType(IntegerType())).add("n_tokens", "long").add("decoded_sha256", "string")

    def run(batches):
        encoder, decoder = once(Encoder, path, pattern), once(Decoder, path)
        for batch in batches:
            for part in _slices(batch):
                made = [encoder.encode(t.as_py()) for t in part.column(text)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in kept), _arrays(made), pa.array([len(x) for x in made], pa.int64()),
                     pa.array([_decoded_sha256(decoder, x) for x in made], pa.string())], [*kept, *new])

    return docs.select(*kept, text).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """The documents without their ids, with the text instead."""
    kept = [c for c in tokens.columns if c not in (ids, text)]
    schema = tokens.select(*kept).schema.add(text, "string")

    def run(batches):
        decoder = once(Decoder, path)
        for batch in batches:
            for part in _slices(batch):
                texts = ["".join(decoder.decode(x.as_py() or ())) for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(texts)], [*kept, text])

    return tokens.select(*kept, ids).mapInArrow(run, schema)


def _slices(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: every text there and back."""

    def run(batches):
        encoder, decoder = once(Encoder, path, pattern), once(Decoder, path)
        words = once(_Words, path).words
        for batch in batches:
            for part in _slices(batch):
                counts, sums, back = [], [], []
                for text in part.column("text"):
                    ids = encoder.encode(text.as_py())
                    counts.append(len(ids))
                    sums.append(hashlib.sha256(" ".join(map(words.__getitem__, ids)).encode()).hexdigest())
                    back.append(_decoded_sha256(decoder, ids))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(sums), pa.array(back)],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


class _Words:
    """Ids in decimal."""

    def __init__(self, path: str):
        self.words = [str(i) for i in range(max(load_ranks(path).values()) + 1)]
