import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.cases import frame, odd_documents
from trafficlens.llm import token_counts as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "\x85", "\xa0", "　", "é", "é", "漢", "😀", "'", "'s", "''", "'ll", "1", "23", "²",
          "the", "ing", " tion", "!!", "...", "<|endoftext|>", "<|endof", "text|>", "<|", "a" * 40, "0" * 50, " " * 30,
          "=" * 70, "\n" * 20, "x" * 90, "ab" * 60, "漢" * 40, "😀" * 30, "'" * 45, "\r\n", "s"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return T.Counter(PATH)


def count_of(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def texts(n, seed, most=60):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, most))) for _ in range(n)]


def spliced(counter, text, step, overlap):
    """The count by seams, or None where a seam finds no proven place."""
    left, right, total = {}, {}, 0
    for number, piece, last in T.chunks(text, step, overlap):
        for side in T.sides(counter, number, piece, last, step, overlap):
            (left if side["left"] else right)[side["seam"]] = side
    for seam, side in left.items():
        n = T.splice(counter, side, right.get(seam))
        if n is None:
            return None
        total += n
    return total


@pytest.mark.parametrize("step, overlap", [(20, 20), (40, 24), (64, 64), (150, 40)])
def test_every_splice_is_right(counter, library, step, overlap):
    seen = 0
    for text in texts(500, step):
        got = spliced(counter, text, step, overlap)
        assert got is None or got == count_of(library, text), text
        seen += got is not None
    assert seen > 30


@pytest.mark.parametrize("run", ["x", "ab", "abc", " ", "\n", "!", "'", "7", "漢", "😀", "é", "é", "qz", "the"])
def test_endless_words(counter, library, run):
    for size in (200, 331, 1000):
        text = "start " + run * size + " end"
        got = spliced(counter, text, 100, 50)
        assert got is None or got == count_of(library, text)


def test_borders_inside_a_word_are_used(counter, library):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("etaoinshrdlu") for _ in range(3000)) for _ in range(20)]
    got = [spliced(counter, w, 300, 60) for w in words]
    assert all(g is None or g == count_of(library, w) for g, w in zip(got, words))
    assert sum(g is not None for g in got) >= 15


def test_counts_equal_the_library(spark, library):
    rows = [(i, t, None, None, 0) for i, t in enumerate(texts(150, 2, 200))] + odd_documents()
    rows += [(1, "x" * 5000, None, None, 0)] * 3 + [(2, "ab " * 4000, None, None, 0), (None, " " * 7000, None, None, 0)]
    got = T.count_tokens(frame(spark, rows), PATH, step=200, overlap=32)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_bytes", "n_tokens"]
    want = sorted((str(r[0]), len((r[1] or "").encode()), count_of(library, r[1])) for r in rows)
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in got.collect()) == want


def test_overlaps_widen_until_all_align(spark, library):
    text = "word " + "abcab" * 700 + " and more"
    rows = [(0, text, None, None, 0), (1, "<|endoftext|>" * 200, None, None, 0), (2, "'" * 3000 + "s", None, None, 0)]
    got = {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(frame(spark, rows), PATH, step=40, overlap=20).collect()}
    assert got == {r[0]: count_of(library, r[1]) for r in rows}


def test_texts_of_production_size(spark, library):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(["light", "papier", "été", "漢字", "x1", "<|endoftext|>", "\n\n", "don't"]) for _ in range(n)), None, None, 0)
            for i, n in enumerate((10, 20_000, 60_000))] + [(3, "z" * 200_000, None, None, 0)]
    got = {r["doc_id"]: r["n_tokens"] for r in T.count_tokens(frame(spark, rows), PATH).collect()}
    assert got == {r[0]: count_of(library, r[1]) for r in rows}


def test_empty_table_and_clashing_columns(spark, library):
    assert T.count_tokens(frame(spark, []), PATH).count() == 0
    rows = [(1, "ab " * 400, None, None, 0), (2, None, None, None, None)]
    got = T.count_tokens(frame(spark, rows, "key seam n piece n_bytes n_tokens"), PATH, step=100, overlap=32)
    assert {(r["doc_id"], r["key"], r["n_tokens"]) for r in got.collect()} == {(1, "key", count_of(library, rows[0][1])), (2, "key", 0)}


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        T.count_tokens(frame(spark, []), public_tokenizers.path("word_bpe_49k.json"))
    with pytest.raises(ValueError):
        T.count_tokens(frame(spark, []), PATH, step=100, overlap=8)
