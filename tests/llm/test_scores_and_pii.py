import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, frame, odd_documents, sentence
from trafficlens.llm import lm_scoring as L, pii, toxicity as X

LABELS = "doc_id long, quality int, toxic int"


# --- toxicity -------------------------------------------------------------------

def labelled(n=600, seed=1):
    """Toxic documents hold made-up insults, some of them disguised."""
    rnd = random.Random(seed)
    insults = ["blorgface", "zugnut", "vermwit"]
    docs, labels = [], []
    for i in range(n):
        words, toxic = sentence(rnd, rnd.randint(5, 80)).split(), int(i % 4 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rnd.randrange(len(words)), rnd.choice(insults) + rnd.choice(["", "s", "!!", "$$$"]))
        docs.append((i, " ".join(words), None, None, None))
        labels.append((i, 1, toxic))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled()
    df = frame(spark, docs, "score word")
    model = X.learn(df, spark.createDataFrame(labels, LABELS))
    rows = X.score(df, model).withColumn("held", X.held_out(F.col("doc_id"))).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held]
    assert len(held) > 100 and all((r.score >= X.TOXIC) == (r.doc_id % 4 == 0) for r in held)


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = labelled()
    turned = [(i, q, t if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - t) for i, q, t in labels]
    df = frame(spark, docs)
    assert X.learn(df, spark.createDataFrame(labels, LABELS)) == X.learn(df, spark.createDataFrame(turned, LABELS))


@pytest.mark.parametrize("text", [
    "You MORON", "you mоrоn", "you m0r0n", "you mo​ron", "you ｍｏｒｏｎ", "moron!!", "$$$ moron$$$",
])
def test_disguises_are_folded(text):
    model = X.Model((" moron",), (2.0,), -1.0)
    assert X.score_text(model, model.automaton(), text) > 0.9


def test_exceptions_and_word_starts():
    model = X.Model((" trash",), (2.0,), -1.0, (" trash can ",))
    machine = model.automaton()
    clean, toxic = X.score_text(model, machine, "hello"), X.score_text(model, machine, "you trash")
    assert X.score_text(model, machine, "the trash can is full") == pytest.approx(clean)
    assert X.score_text(model, machine, "cyberntrash") == pytest.approx(clean) and toxic > clean
    # The same hits count less in a longer text.
    assert X.score_text(model, machine, "trash " + "word " * 500) < toxic


def test_entries_that_find_the_same_are_joined():
    counts = [(" abc", 9, 0), (" abcd", 9, 0), (" abcd ", 9, 0), (" ab", 9, 3), (" ab ", 5, 3)]
    assert X.choose(counts) == [" abcd", " ab", " ab "]


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(0, 1, None), (None, 1, 1)]])
def test_toxicity_without_examples(spark, labels):
    model = X.learn(frame(spark), spark.createDataFrame(labels, LABELS))
    scores = [r.score for r in X.score(frame(spark), model).collect()]
    assert len(scores) == len(odd_documents()) and set(map(round, scores)) == {0}
    assert X.score(spark.createDataFrame([], SCHEMA), model).count() == 0


def test_only_toxic_examples(spark):
    labels = spark.createDataFrame([(i, 1, 1) for i in range(20)], LABELS)
    assert X.learn(frame(spark), labels) == X.Model(bias=500.0)


# --- language model ---------------------------------------------------------------

def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [None]


def check_base(rows, docs):
    train = Counter()
    for i, text, *_ in docs:
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            train.update(words_of(text))
    total, distinct = sum(train.values()), len(train)
    want = []
    for i, text, *_ in docs:
        words = words_of(text)
        base = sum(math.log10((train[w] + 1) / (total + distinct + 1)) for w in words)
        held = i is not None and zlib.crc32(str(i).encode()) % 7 == 2
        want.append((str(i), held, len(words), sum(train[w] > 0 for w in words), total, round(base, 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in rows]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("top", [1 << 20, 5], ids=["all in the top", "most words joined"])
def test_base_scores_equal_force(spark, monkeypatch, top):
    monkeypatch.setattr(L, "TOP", top)
    monkeypatch.setattr(L, "RANGE_BYTES", 20_000)
    check_base(L.score(frame(spark, extra="word times score")).collect(), odd_documents())


def test_model_beats_base_on_held_out_texts(spark):
    rnd = random.Random(4)
    follow = {}

    def text():
        word, out = "the", []
        for _ in range(rnd.randint(20, 60)):
            # Each word is mostly followed by one of two others.
            word = rnd.choice(follow.setdefault(word, [rnd.choice(words) for _ in range(2)])) if rnd.random() < 0.9 else rnd.choice(words)
            out.append(word)
        return " ".join(out)

    words = [f"w{i}" for i in range(80)]
    docs = [(i, text(), None, None, None) for i in range(400)]
    rows = [r for r in L.score(frame(spark, docs)).collect() if r.held_out]
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)
    assert all(r.score < 0 for r in rows)


def test_prior_is_that_of_all_training_texts(spark):
    # The 500 training texts whose ids have the smallest hashes are noise, all others a song.
    ids = spark.range(3000).where(~L.held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").limit(500)
    noisy, rnd = {r.id for r in ids.collect()}, random.Random(6)
    song = [f"s{i}" for i in range(40)]
    docs = []
    for i in range(3000):
        at = rnd.randrange(40)
        words = [f"n{rnd.randrange(300)}" for _ in range(40)] if i in noisy else (song * 2)[at:at + 30]
        docs.append((i, " ".join(words), None, None, None))
    known = [words_of(t) for i, t, *_ in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    single, both = Counter(w for t in known for w in t), Counter(p for t in known for p in zip(["<"] + t, t))
    single["<"], whole = len(known), sum(single.values()) + len(single) + 1

    def likely(texts, m, out):
        steps = [(both[p], single[p[0]], (single[p[1]] + 1) / whole) for t in texts for p in zip(["<"] + t, t)]
        return sum(math.log10((max(b - out, 0) + m * s) / (max(v - out, 0) + m)) for b, v, s in steps)

    best = max(L.PRIORS, key=lambda m: likely(known, m, 1))
    got = sum(r.score for r in L.score(frame(spark, docs)).collect())
    assert min(L.PRIORS, key=lambda m: abs(likely([words_of(t) for _, t, *_ in docs], m, 0) - got)) == best


def test_filter_too_large_to_broadcast_gives_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(L, "RANGE_BYTES", 20_000)
    docs = frame(spark)

    def found():
        return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6)) for r in L.score(docs).collect())

    want = found()
    monkeypatch.setattr(L, "MOST_BITS", 4096)
    assert found() == want


def test_a_filter_in_parts_writes_neither_texts_nor_pairs(spark, monkeypatch):
    """Texts and questions only move; of counts the words are kept, pairs only as filter."""
    monkeypatch.setattr(L, "RANGE_BYTES", 20_000)
    monkeypatch.setattr(L, "MOST_BITS", 4096)
    tables, real = {}, L.written
    monkeypatch.setattr(L, "written", lambda df, name: tables.setdefault(name, real(df, name)))
    L.score(frame(spark))
    assert set(tables) == {"lm-counts", "lm-scored"}
    assert tables["lm-counts"].columns == ["range", "word", "count", "bits", "part"]


def test_planes_keep_numbers():
    keys = np.sort(np.random.default_rng(1).integers(0, 2**64, 3000, dtype=np.uint64))
    for part in (keys, keys[:1], keys[:0], keys[100:200]):
        assert (L._keys(L._planes(part)) == part).all() and len(L._planes(part)) == 8 * len(part)


def test_filter_never_answers_too_low():
    rng = np.random.default_rng(0)
    grams = np.unique(rng.integers(0, 2**64, 5000, dtype=np.uint64))
    counts = rng.integers(1, 400, len(grams))
    levels = L.level(counts)
    bits = int(levels.sum()) * L.ENTRY_BITS // 64 * 64
    model = L.Model(L.part_of(grams, levels, bits), np.zeros(1, np.int64), np.array([bits]), 1, 1, 1, grams[:0], counts[:0])
    answers = model.levels(grams)
    assert (answers >= levels).all() and (answers == levels).mean() > 0.9
    strange = np.setdiff1d(rng.integers(0, 2**64, 5000, dtype=np.uint64), grams)
    assert (model.levels(strange) > 0).mean() < 0.1


def test_levels_stand_for_their_counts():
    counts = np.arange(1, 5000)
    assert (np.abs(L.VALUES[L.level(counts)] - counts) <= 0.21 * counts + 0.5).all()
    assert L.VALUES[0] == 0 and L.VALUES[L.level(np.array([1]))[0]] == 1


def test_scores_without_training_texts(spark):
    assert L.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = [(i, "some words", None, None, None) for i in held]
    check_base(L.score(frame(spark, docs)).collect(), docs)


# --- personal data ------------------------------------------------------------------

def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()]
        doubled = [d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits))]
        if 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def tricky(n=500):
    rnd = random.Random(3)
    parts = list("aZ9_.%+- @1234567890") + [
        "1.2.3.4", "255.256.1.1", "4111 1111-1111 1111", "a@b.com", "+1 (974) 555-3436", "é", "😀", " . ", "@x", "..", "0000", "\n",
        "call 974 555-3436 now", "bob (at) x (dot) com"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    return texts + ["1" * 20000, "a" * 50000, "1 " * 9000, "+1" + "." * 30000, "1.1." * 5000, None, "", "a@b." * 3000]


def test_base_spans_equal_force(spark):
    texts = tricky() + [r[1] for r in odd_documents()]
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)], "spans votes")
    rows = pii.find(docs).select(
        "doc_id", pii.written_form(F.col("base_spans")).alias("base"), pii.written_form(F.col("spans")).alias("all"),
        *[pii.count_of(F.col("base_spans"), k).alias(k) for k in pii.KINDS]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id] or "")
        assert r.base == want, texts[r.doc_id][:80]
        assert [r[k] for k in pii.KINDS] == [want.count(f"{k}:") for k in pii.KINDS]
        # Base spans stay.
        assert set(filter(None, want.split(","))) <= set(r.all.split(","))


def test_reliable_labelers_are_found():
    rnd, counts = random.Random(1), Counter()
    for _ in range(4000):
        truth = rnd.random() < 0.4
        right = [0.95, 0.9, 0.85, 0.8, 0.5]
        counts[tuple((2 if truth else 0) if rnd.random() < p else (0 if truth else 2) for p in right)] += 1
    share, tables, belief = pii.reliabilities(counts)
    assert share == pytest.approx(0.4, abs=0.05)
    assert [t[True][2] > 0.7 for t in tables] == [True] * 4 + [False]
    assert belief[2, 2, 2, 2, 2] > 0.95 and belief[0, 0, 0, 0, 0] < 0.05


def test_masked_numbers_are_added_and_prose_is_left_alone(spark):
    texts = [f"please call phone 97{i % 10} 555-34{i:02d} now" for i in range(40)]
    texts += [f"phone +1 (974) 555-34{i:02d} or call +49 30 1234{i:02d}" for i in range(40)]
    texts += [f"version 12.345.{i} of part 1234 5678 in the year 2024" for i in range(40)] + ["the river and the stone"] * 20
    docs = frame(spark, [(i, t, None, None, None) for i, t in enumerate(texts)])
    rows = {r.doc_id: r.s for r in pii.find(docs).select("doc_id", pii.written_form(F.col("spans")).alias("s")).collect()}
    assert sum(rows[i].startswith("phone:") for i in range(40)) == 40
    assert all(not rows[i] for i in range(80, 140))


def test_redaction(spark):
    rows = [(1, "a jo@x.com b 10.0.0.1 c", None, None, 23), (2, "nothing here", None, None, 12), (3, None, None, None, None),
            (4, "+4111111111111111", None, None, 17)]
    out = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(frame(spark, rows, "spans"), {}).collect()}
    assert out[1] == ("a <EMAIL> b <IP> c", 18) and out[2] == ("nothing here", 12) and out[3] == (None, 0)
    assert out[4][0] in ("<PHONE>", "+<CARD>", "<CARD>")
    assert pii.redact(spark.createDataFrame([], SCHEMA)).count() == 0
