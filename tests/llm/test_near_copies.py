import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import SCHEMA, frame, odd_documents, sentence
from trafficlens.llm import components, embedding_near_dedup as E, ngram_jaccard as J, order_minhash as O, words as W


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


# --- words ----------------------------------------------------------------------

def split(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def test_word_and_shingle_hashes(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(W, "CHUNK_BYTES", 500)
    texts = [r[1] for r in odd_documents()] + ["x\x1cy", "ab", "ab"]
    data, starts = W.text_bytes(pa.array(texts))
    seen, at = {}, 0
    for first, last, part, bounds in W.chunks(data, starts):
        hashes, cuts = W.words(part, bounds)
        for i, text in enumerate(texts[first:last]):
            own = hashes[cuts[i]:cuts[i + 1]]
            assert len(own) == len(split(text))
            for word, value in zip(split(text), own):
                assert seen.setdefault(word, value) == value
        at = last
    assert at == len(texts) and len(set(seen.values())) == len(seen)


# --- components -----------------------------------------------------------------

@pytest.mark.parametrize("links", [
    [], [(1, 1)], [(2, 1), (3, 2), (1, 3)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)] + [(50, 51)],
])
def test_components(spark, links):
    got = components.components(spark.createDataFrame(links or [(9, 9)], "a long, b long"))
    want = groups(80, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {(r.id, r.component) for r in got.collect()} == {(i, want[i]) for i in linked}


# --- n-gram Jaccard join --------------------------------------------------------

def shingles(text):
    words = split(text)
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def by_force(rows):
    sets = [shingles(r[1]) for r in rows]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                links.append((j, i))
    root = groups(len(rows), links)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), (min(ids) if ids else None) if sets[i] else r[0]))
    return sorted(out, key=str)


def mixed_groups(seed=1, n=40):
    """Near copies just above and below the limit, a shared passage, and a hot group."""
    rnd = random.Random(seed)
    passage, texts = sentence(rnd, 30), []
    for _ in range(n):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(5, 80))]
        texts.append(" ".join(words))
        if rnd.random() < 0.5:
            texts.append(" ".join(words[:-rnd.randint(1, max(1, len(words) // 4))]))
        if rnd.random() < 0.4:
            texts.append(" ".join(words) + " " + passage)
    base = [f"v{i}" for i in range(100)]
    for i in range(25):
        copy = list(base)
        copy[rnd.randrange(100)] = f"other{i}"
        texts.append(" ".join(copy))
    return [(i * 3 % 1009, t, None, None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("rows", [odd_documents(), mixed_groups()], ids=["odd", "groups"])
def test_jaccard_join_equals_force(spark, rows, monkeypatch):
    monkeypatch.setattr(J, "CHUNK", 4)
    got = sorted((tuple(r) for r in J.link(frame(spark, rows, "class shingle")).collect()), key=str)
    assert got == by_force(rows)


def copies_of_one(n=120, seed=7):
    """Copies of one text, each with three of eight places changed: two copies are alike
    enough if they share a place, so the smallest one is not linked with all others."""
    rnd, rows = random.Random(seed), []
    for i in range(n):
        words = [f"w{k}" for k in range(200)]
        for place in rnd.sample(range(8), 3):
            words[10 + 20 * place] = f"new{i}x{place}"
        rows.append((i + 1, " ".join(words), None, None, None))
    return rows


@pytest.mark.parametrize("chunk", [16])
def test_jaccard_moves_only_tiles_that_need_it(spark, monkeypatch, chunk):
    """Bitmaps go to classes with another one in their size band, and are gone in the end."""
    monkeypatch.setattr(J, "CHUNK", chunk)
    far = [(1000 + i, " ".join(f"w{k}" for k in range(6 + 40 * i)), None, None, None) for i in range(4)]
    rows, listed, real = copies_of_one() + far, [], J.Scratch.written

    def noted(self, df, name):
        out = real(self, df, name)
        if name == "jaccard-tiles":
            sizes = [[c.size for c in r.classes] for r in out.select("classes").collect()]
            listed.append((self.paths[-1], sizes))
        return out

    monkeypatch.setattr(J.Scratch, "written", noted)
    got = sorted((tuple(r) for r in J.link(frame(spark, rows)).collect()), key=str)
    assert got == by_force(rows)
    [(path, sizes)] = listed
    assert not os.path.exists(path.removeprefix("file:")), path
    assert sizes and not {2, 42, 82} & {x for part in sizes for x in part}, sizes


@pytest.mark.parametrize("chunk", [512, 16])
def test_jaccard_links_of_a_large_group_do_not_grow_with_its_square(spark, monkeypatch, chunk):
    """The links that are written join the group, and are not all links of it."""
    monkeypatch.setattr(J, "CHUNK", chunk)
    rows, made, real = copies_of_one(), [], J.written
    all_links = sum(4 * len(a & b) >= 3 * len(a | b) for i, a in enumerate(map(shingles, (r[1] for r in rows)))
                    for b in map(shingles, (r[1] for r in rows[:i])))

    def noted(df, name):
        out = real(df, name)
        if name == "jaccard-links":
            made.append(out.count())
        return out

    monkeypatch.setattr(J, "written", noted)
    got = sorted((tuple(r) for r in J.link(frame(spark, rows)).collect()), key=str)
    assert got == by_force(rows)
    assert all_links > 1800 and sum(made) <= 6 * len(rows), (all_links, made)


def test_jaccard_counts_shingles_without_holding_them_often():
    """Beside the sets of a batch a task holds their shingles once more, not several times."""
    import tracemalloc

    import pyarrow as pa

    rnd, n = random.Random(3), 8000
    texts = ["all have this one passage " + " ".join(f"{rnd.randrange(1 << 40):x}" for _ in range(300)) for _ in range(n)]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n), pa.int64())] * 2 + [pa.array(texts)], ["row", "doc_id", "text"])
    list(J._summaries(iter([batch.slice(0, 10)])))
    tracemalloc.start()
    *_, often = J._summaries(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert often.column("times").to_pylist() == [n] and peak < 3.5 * 8 * 301 * n, peak / (8 * 301 * n)


def test_jaccard_and_toxicity_release_what_other_operators_keep(spark):
    """A worker that has encoded texts does not hold the encoder's tables beside the next stage."""
    import public_tokenizers
    import pyarrow as pa

    from trafficlens.llm import byte_bpe, kept, toxicity

    numbers, texts = pa.array([1, 2], pa.int64()), pa.array(["one two three four five six", None])
    named = pa.RecordBatch.from_arrays([numbers, numbers, texts], ["row", "doc_id", "text"])
    marked = pa.RecordBatch.from_arrays([pa.array(["good", "bad"]), pa.array([0, 1])], ["text", "toxic"])
    for task, batch in ((J._summaries, named), (toxicity._counts, marked)):
        kept.once(byte_bpe.Decoder, public_tokenizers.path("byte_bpe_50k.tiktoken"))
        assert kept._made
        assert list(task(iter([batch]))) and not kept._made


def test_jaccard_joining_links_of_a_tile():
    """Links that join what all links join, behind what is joined already, few of them compared."""
    rng, base = np.random.default_rng(4), np.arange(1, 401, dtype=np.uint64)
    sets = [np.unique(np.concatenate((rng.choice(base, 350, replace=False), rng.integers(1 << 40, 1 << 50, rng.integers(0, 12), dtype=np.uint64))))
            for _ in range(60)]
    sets += [base + np.uint64(1000), base[20:] + np.uint64(1000), base + np.uint64(9000)]
    n = len(sets)
    i, j = np.triu_indices(n, 1)
    every = [(a, b) for a, b in zip(i.tolist(), j.tolist()) if J.alike(sets[a], sets[b])]
    assert len(every) > 500
    for before in (np.arange(n), np.where(np.arange(n) < 30, 0, np.arange(n))):
        joined = before.copy()
        links = J.joining_links(sets, i, j, joined)
        want = groups(n, every + [(int(x), k) for k, x in enumerate(before)])
        assert set(links) <= set(every) and len(links) == len(set(before)) - len(set(want))
        assert groups(n, links + [(int(x), k) for k, x in enumerate(before)]) == want
        assert len(set(zip(joined.tolist(), want))) == len(set(want)) == len(set(joined.tolist()))


def test_jaccard_keeps_one_of_each(spark):
    docs = frame(spark, extra="row __class")
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    want = {r[2] for r in by_force(odd_documents()) if r[1]}
    rows = kept.collect()
    assert sorted(r.doc_id for r in rows if split(r.text)) == sorted(want)
    # Documents without words are near copies of nothing.
    assert sum(not split(r.text) for r in rows) == sum(not split(r[1]) for r in odd_documents())


def test_jaccard_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert J.link(empty).count() == 0 and J.one_of_each(empty).count() == 0
    blank = frame(spark, [(1, None, None, None, None), (2, " ", None, None, None)])
    assert sorted(map(tuple, J.link(blank).collect())) == [(1, 0, 1), (2, 0, 2)]


def test_bitmaps_never_lose_a_pair():
    rng = np.random.default_rng(0)
    sets = []
    for n in (1, 2, 20, 300, 700, 1500):
        base = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        for share in (1.0, 0.9, 0.85, 0.5):
            own = base[: max(1, int(n * share))]
            sets.append(np.unique(np.concatenate((own, rng.integers(0, 2**63, int(n * 0.05), dtype=np.uint64)))))
    bits, size = [J.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    i, j = (x.ravel() for x in np.indices((len(sets), len(sets))))
    good = J.room_for(bits, bits, size, size, i, j)
    for a, b, ok in zip(i, j, good):
        shared = len(np.intersect1d(sets[a], sets[b]))
        if 4 * shared >= 3 * (size[a] + size[b] - shared):
            assert ok
    assert not good.all()


def test_prefixes_of_linked_sets_meet():
    slots = np.zeros(1 << 24, np.uint8)
    slots[::3] = 2
    rng = np.random.default_rng(1)
    for _ in range(200):
        base = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        a, b = np.sort(rng.choice(base, 54, replace=False)), np.sort(rng.choice(base, 54, replace=False))
        shared = len(np.intersect1d(a, b))
        if 4 * shared >= 3 * (len(a) + len(b) - shared):
            assert len(np.intersect1d(J.first_shingles(a, slots), J.first_shingles(b, slots)))


# --- embeddings -----------------------------------------------------------------

def vectors(seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for g in range(30):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append((len(rows), (base + rng.normal(scale=0.12, size=16)).astype(np.float32).tolist(), g % 3))
    hot = rng.normal(size=16)
    rows += [(len(rows) + i, (hot + rng.normal(scale=0.02, size=16)).astype(np.float32).tolist(), 1) for i in range(150)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [1.0] * 8,
           [1e-30] * 16, [1e30] * 16]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(2000, rows[0][1], None), (2001, rows[0][1], 2), rows[3], rows[3], (None, rows[5][1], rows[5][2])]
    return rows


def test_embeddings_equal_force(spark, monkeypatch):
    monkeypatch.setattr(E, "CHUNK", 16)
    rows = vectors()

    def fine(v, label):
        return label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) if fine(v, x) else None for _, v, x in rows]
    links = [(j, i) for i in range(len(rows)) for j in range(i)
             if unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j])
             and (unit[i] @ unit[j] >= 0.93 or rows[i][1] == rows[j][1])]
    root, degree = groups(len(rows), links), [0] * len(rows)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        component = min(ids) if ids else None
        want.append((r[0], degree[i], component, r[0] == component))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("class", F.lit("x")).repartition(4)
    got = [tuple(r) for r in E.near_dedup(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def one_way(seed=3):
    """A label whose vectors point the same way (mean cosine 0.8, planted pairs at 0.94), and
    one with a dense group and stragglers at its rim."""
    rng = np.random.default_rng(seed)

    def unit(*shape):
        x = rng.normal(size=shape)
        return x / np.linalg.norm(x, axis=-1, keepdims=True)

    way, noise = unit(48), unit(2500, 48)
    noise[:200] = 0.7 * noise[200:400] + 0.51 ** 0.5 * noise[:200]
    spread = 0.8 ** 0.5 * way + 0.2 ** 0.5 * noise
    dense = 0.995 ** 0.5 * way + 0.005 ** 0.5 * unit(600, 48)
    rim = 0.9 * way + 0.19 ** 0.5 * unit(200, 48)
    return [*((v.tolist(), 0) for v in spread), *((v.tolist(), 1) for v in (*dense, *rim))]


def test_embeddings_that_no_window_meets(spark):
    rows = [(i, *r) for i, r in enumerate(one_way())]
    matrix = np.array([v for _, v, _ in rows], np.float32).astype(np.float64)
    matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
    label = np.array([x for *_, x in rows])
    near = (matrix @ matrix.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    root = groups(len(rows), zip(*(x.tolist() for x in np.nonzero(near))))
    want = [(i, int(n), root[i], root[i] == i) for i, n in enumerate(near.sum(axis=1))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    assert sorted(map(tuple, E.near_dedup(df).collect())) == want


def test_chunks_are_cut_where_vectors_spread():
    rng = np.random.default_rng(5)
    # Four tight bundles, mixed up: two far apart, each of two nearer ones.
    way, far, near = 0.9 * np.ones(32) / 32 ** 0.5, 0.3 * np.eye(32)[0], 0.1 * np.eye(32)[1]
    centres = np.array([way + far + near, way + far - near, way - far + near, way - far - near])
    which = rng.permutation(np.repeat(np.arange(4), E.CHUNK))
    matrix = centres[which] + rng.normal(scale=0.002, size=(len(which), 32))
    parts = list(E._cut(matrix, np.arange(len(matrix))))
    assert sorted(np.concatenate(parts).tolist()) == list(range(len(matrix)))
    assert all(len(p) <= E.CHUNK and len(set(which[p])) == 1 for p in parts)


def test_embeddings_empty(spark):
    assert E.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_more_vectors_need_more_passes():
    assert E.passes_for(10) <= E.passes_for(10_000) < E.passes_for(10**9)


# --- order minhash --------------------------------------------------------------

def test_fingerprint_is_sensitive_to_order_and_repeats():
    rnd = random.Random(2)
    text = sentence(rnd, 300)
    words = text.split()
    turned = " ".join(words[150:] + words[:150])
    own = O.fingerprint(text)
    assert O.likeness(own, O.fingerprint(text)) == 1.0
    near = O.likeness(own, O.fingerprint(text.replace(words[20], "zzzz", 1)))
    assert near > 0.8 and O.likeness(own, O.fingerprint(turned)) < near
    assert O.likeness(own, O.fingerprint(sentence(rnd, 300))) < 0.1
    # The same set of k-mers, but not as often.
    assert O.likeness(O.fingerprint("abcabcabc" * 4), O.fingerprint("abcabcabc" * 12)) < 1.0


def test_fingerprint_of_short_and_long_texts():
    assert not O.fingerprint("").any() and not O.fingerprint(None).any()
    assert len(O.text_form(O.fingerprint("a"))) == 4 * O.SKETCHES
    assert O.likeness(O.fingerprint("ab"), O.fingerprint("ac")) == 0.0
    assert O.fingerprint("é漢😀" * 5000).any()


def test_packed_and_plain_sorting_agree(monkeypatch):
    text = sentence(random.Random(3), 400)
    packed = O.fingerprint(text)
    hashes = np.array([5, 1, 5, 1], np.uint64)
    places = np.array([0, 1, 2, 3], np.uint64)
    order = np.lexsort((places, hashes))
    assert [x.tolist() for x in O._sorted(hashes, places)] == [hashes[order].tolist(), places[order].tolist()]
    assert O.likeness(packed, O.fingerprint(text)) == 1.0


@pytest.mark.parametrize("group_rows", [1000, 4])
def test_neighbours_equal_force(spark, monkeypatch, group_rows):
    monkeypatch.setattr(O, "GROUP_ROWS", group_rows)
    rows = [(i * 7 % 101, t, None, None, None) for i, (_, t, *_) in enumerate(odd_documents()[:80])]
    got = {r.doc_id: r for r in O.compare_neighbours(frame(spark, rows, "fingerprint")).collect()}
    ordered = sorted(rows)
    assert len(got) == len(rows)
    for i, (doc_id, text, *_) in enumerate(ordered):
        text, after = text or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        own, changed = O.fingerprint(text), O.fingerprint(edited)
        r = got[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (O.text_form(own), O.text_form(changed))
        assert (r.near_edited, r.near_next) == (O.likeness(own, changed), O.likeness(own, O.fingerprint(after)))


def test_neighbours_of_repeated_null_and_no_ids(spark):
    assert O.compare_neighbours(spark.createDataFrame([], SCHEMA)).count() == 0
    assert O.compare_neighbours(frame(spark)).count() == len(odd_documents())
    one = O.compare_neighbours(frame(spark, [(None, "abc", None, None, None)])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
