import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.cases import frame
from trafficlens.llm import phrases

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows, longest=3, least=10, share=50, top=2000):
    counts, totals = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(AZ)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(words)
            for n in range(1, longest + 1):
                for i in range(len(words) - n + 1):
                    counts[lang or "und"][tuple(words[i:i + n])] += 1
    out = set()
    for lang, seen in counts.items():
        found = [p for p, a in seen.items() if len(p) > 1 and a >= least]
        hidden = {p[i:i + n] for p in found for n in range(2, len(p)) for i in range(len(p) - n + 1)
                  if 100 * seen[p] >= share * seen[p[i:i + n]]}
        rows = []
        for p in found:
            if p not in hidden:
                a = seen[p]
                score, _, l, r = min((1000000 * a * a // (seen[p[:k]] * seen[p[k:]]), k, seen[p[:k]], seen[p[k:]])
                                     for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), a, l, r))
        for rank, (score, _, phrase, a, l, r) in enumerate(sorted(rows)[:top], 1):
            out.add((lang, rank, phrase.decode(), a, l, r, totals[lang], -score))
    return out


def texts(n, seed):
    rnd = random.Random(seed)
    words = ["New", "york", "CITY", "a", "b", "of", "the", "É", "é", "漢字", "x" * 50, "\xa0", "\x1c", "nul\0"]
    ends = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r\n", "!", "\x0b", " ;"]
    made = ["".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(0, 40))) for _ in range(n)]
    return [(i, t, rnd.choice(["en", "de", "und", None]), None, 0) for i, t in enumerate(made)]


def result(spark, rows, **settings):
    return phrases.collocations(frame(spark, rows), **settings)


def test_phrases_equal_brute_force(spark):
    rows = texts(400, 1) + [(1, None, None, None, None), (2, "", "en", None, 0), (3, " . ,\n", "en", None, 0)]
    got = result(spark, rows)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {tuple(r) for r in got.collect()} == by_force(rows)


@pytest.mark.parametrize("longest", [2, 4])
def test_other_lengths(spark, longest):
    rows = texts(150, longest)
    got = result(spark, rows, longest=longest, least=3, top=40)
    assert {tuple(r) for r in got.collect()} == by_force(rows, longest, 3, top=40)


def test_long_texts_are_cut_without_loss(spark, monkeypatch):
    rows = [(0, "new york city. " * 300 + "one two three four " * 500 + "y" * 5000, "en", None, 0)] + texts(60, 5)
    assert {tuple(r) for r in result(spark, rows).collect()} == by_force(rows)
    # The same in small chunks, in this process.
    for size in (1, 7, 64, 1000):
        monkeypatch.setattr(phrases, "CHUNK_BYTES", size)
        buffer, seen = phrases._Buffer("en", 3), Counter()
        for row in rows:
            for batch in [*buffer.add(row[1].encode().translate(phrases._FOLD)), *buffer.flush()]:
                for got in batch.to_pylist():
                    first, lang, *rest = got["gram"].split("\n")
                    assert lang == "en"
                    seen[first, *rest] += got["n"]
        want = Counter()
        for row in rows:
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", row[1].translate(AZ)):
                words = re.findall(r"[^\x20\x09]+", piece)
                want.update(zip(words, words[1:] + [""], words[2:] + ["", ""]))
        assert seen == want, size


def test_folding_keeps_frequent_counts():
    rnd = random.Random(11)
    windows = Counter()
    for _ in range(6000):
        words = [rnd.choice("abcdefgh") + rnd.choice(["", "", "x\x01"]) for _ in range(rnd.randint(1, 3))]
        windows["\n".join([words[0], rnd.choice(["en", "d\\\\n", "l\\ne"]), *(words[1:] + ["", ""])[:2]])] += 1
    ordered = sorted(windows.items(), key=lambda x: x[0].encode())

    def sums(rows):
        out = Counter()
        for lang, *words, n in rows:
            for k in range(4):
                if all(words[:k]):
                    out[lang, *words[:k]] += n
        return out

    plain = []
    for gram, n in ordered:
        first, lang, *rest = gram.split("\n")
        plain.append(({"en": "en", "d\\\\n": "d\\n", "l\\ne": "l\ne"}[lang], first, *rest, n))
    for size in (1, 2, 50, 10_000):
        rows = []
        for i in range(0, len(ordered), size):
            grams, counts = zip(*ordered[i:i + size])
            columns, n = phrases._folded(pa.array(grams), np.array(counts), 3, 10)
            rows += zip(*(c.to_pylist() for c in columns), n.tolist())
        want, got = sums(plain), sums(rows)
        assert {k: v for k, v in want.items() if v >= 10} == {k: v for k, v in got.items() if v >= 10}
        assert size < 10_000 or len(rows) < len(ordered) / 2


def test_many_candidates_and_languages(spark, monkeypatch):
    monkeypatch.setattr(phrases, "RANKED_ROWS", 5)
    rows = [(i, t, f"l{i % 40}", None, 0) for i, (_, t, *_) in enumerate(texts(400, 7))]
    assert {tuple(r) for r in result(spark, rows, least=2, top=6).collect()} == by_force(rows, least=2, top=6)


def test_ties_and_bytes_order(spark):
    rows = [(i, "é z. É y. ~ q. a b", "en", None, 0) for i in range(10)]
    got = [(r["rank"], r["phrase"]) for r in result(spark, rows).orderBy("rank").collect()]
    assert got == [(1, "a b"), (2, "~ q"), (3, "É y"), (4, "é z")]


def test_large_counts_stay_exact(spark):
    big = 999_999_999_999_937
    grams = spark.createDataFrame([("en", "a b", ["a", "b"], big)], "lang string, phrase string, words array<string>, f long")
    counts = spark.createDataFrame([("en", "a", big + 4), ("en", "b", big + 8)], "lang string, phrase string, f long")
    row = phrases.scored(grams, counts).first()
    assert row["score"] == 1000000 * big * big // ((big + 4) * (big + 8))


def test_empty_table_and_clashing_columns(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    rows = texts(80, 9)
    clashing = frame(spark, rows, "phrase words f n rank w1 w2 piece")
    assert {tuple(r) for r in phrases.collocations(clashing).collect()} == by_force(rows)
