import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tests.llm.cases import SCHEMA, frame, odd_documents
from trafficlens.llm import byte_bpe, token_files

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "é", "é", "漢", "😀", "'", "'s", "S'", "'LL", "1", "23",
          "²", "the", "ing", " tion", "Σ", "!!", "...", "_", "<|endoftext|>", "​", "\xa0", "ß", "İ", "Ж", "̀",
          "\U0001f468‍\U0001f469", "a" * 40, "0" * 50, " " * 30, "=" * 70, "\r", ".", "A.", "s.", '"', "("]


def random_texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 30))) for _ in range(n)]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)


def test_transducer_equals_merges(encoder, reference):
    decoder = byte_bpe.Decoder(RANKS)
    for text in random_texts(1500, 1):
        ids = encoder.encode(text)
        assert ids == reference.encode_ordinary(text), text
        assert decoder.decode_bytes(ids) == text.encode() and "".join(decoder.decode(ids)) == text


def test_transducer_on_long_pieces(encoder, reference):
    rnd = random.Random(3)
    for n in (1000, 20000):
        text = "".join(rnd.choice("etaoinshrdlu") for _ in range(n))
        assert encoder.encode(text) == reference.encode_ordinary(text)


def test_transducer_emits_early_and_stays_small(encoder):
    machine = encoder.transducer
    machine._clear()
    machine.encode(b"ab" * 20000)
    assert max(len(pending) for state in machine.states for _, pending in state) < 40


def test_states_do_not_depend_on_far_tokens(encoder, reference):
    machine = encoder.transducer
    machine._clear()
    rnd = random.Random(5)
    for _ in range(300):
        piece = "".join(rnd.choice(["tion", "ent", "er", "ing"]) for _ in range(8))
        assert machine.encode(piece.encode()) == reference.encode_ordinary(piece)
    assert max(len(pending) for state in machine.states for _, pending in state) <= 1


def test_results_do_not_depend_on_kept_tables(reference, monkeypatch):
    monkeypatch.setattr(byte_bpe, "KEPT_PIECES", 3)
    monkeypatch.setattr(byte_bpe, "KEPT_STATES", 20)
    monkeypatch.setattr(byte_bpe, "KEPT_VERDICTS", 5)
    small = byte_bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    for text in random_texts(150, 2):
        assert small.encode(text) == reference.encode_ordinary(text)


def test_utf8_machine_at_every_cut():
    data = "aé漢😀z".encode()
    for i in range(len(data) + 1):
        for j in range(i, len(data) + 1):
            machine = byte_bpe.Utf8()
            assert machine.feed(data[:i]) + machine.feed(data[i:j]) + machine.feed(data[j:], last=True) == "aé漢😀z"
    machine = byte_bpe.Utf8()
    assert machine.feed(b"\xe6\xbc") + machine.feed(b"", last=True) == "�"


def test_bpe_digests_of_documents(spark, reference):
    rows = byte_bpe.digests(frame(spark), RANKS, public_tokenizers.PATTERN).collect()
    want = []
    for doc_id, text, *_ in odd_documents():
        ids = reference.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))


def test_bpe_round_trip_and_clashing_names(spark):
    docs = frame(spark, extra="ids n_tokens")
    tokens = byte_bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    assert tokens.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "decoded_sha256"]
    back = byte_bpe.decode(tokens, RANKS)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), r[1] or "") for r in odd_documents())
    assert byte_bpe.encode(spark.createDataFrame([], SCHEMA), RANKS, public_tokenizers.PATTERN).count() == 0


def test_word_encoder_equals_library(monkeypatch):
    library = Tokenizer.from_file(WORD_BPE)
    monkeypatch.setattr(token_files, "KEPT_WORDS", 50)
    encoder = token_files.Encoder(WORD_BPE)
    texts = random_texts(2000, 4) + [None, "", "Word. word, WORD! (word) it's its' 3.14"] + [
        "hello <|endoftext|> world", "<|startoftext|>", "a<|endoftext|>b<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> <|EndOfText|>",
        "<|endof<|endoftext|>text|>", "e<|endoftext|>\u0301x", " <|endoftext|>  <|startoftext|>\n", "<|endoftext|", "x<|startoftext|>'s"]
    for i in range(0, len(texts), 100):
        part = texts[i:i + 100]
        for text, data in zip(part, encoder.encode(part, 1)):
            assert list(np.frombuffer(data, "<u2")) == library.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_encoder_merges_letters_together():
    letters = [chr(c) for c in [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)] if c not in (0xD7, 0xF7)]
    rng = np.random.default_rng(5)
    words = letters + ["".join(rng.choice(letters, n)) for n in rng.integers(1, 30, 3000)]
    encoder, alone = token_files.Encoder(WORD_BPE), []

    class Library:
        """The library, with a list of what it is asked one by one."""

        def encode_batch_fast(self, texts, **options):
            alone.extend(texts)
            return library.encode_batch_fast(texts, **options)

    library, encoder.tokenizer = encoder.tokenizer, Library()
    [data] = encoder.encode([" ".join(words)], 1)
    assert list(np.frombuffer(data, "<u2")) == library.encode(" ".join(words), add_special_tokens=False).ids + [1]
    assert alone == []
    encoder.ends[:] = False  # a vocabulary that marks no ends
    encoder.kept, encoder.parts = {}, {}
    assert encoder.encode([" ".join(words)], 1) == [data] and alone


def test_token_files_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "PART_BYTES", 20_000)
    library = Tokenizer.from_file(WORD_BPE)
    rows = token_files.round_trip(spark, frame(spark), WORD_BPE, 49408).collect()
    ids = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [1]) for r in odd_documents()]
    want = sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in rows) == want
    rows = sorted(rows, key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at
        at += r.n_tokens
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    assert token_files.round_trip(spark, spark.createDataFrame([], SCHEMA), WORD_BPE, 49408).count() == 0


def test_id_width():
    assert token_files.id_type(65536) == "<u2" and token_files.id_type(65537) == "<u4"
