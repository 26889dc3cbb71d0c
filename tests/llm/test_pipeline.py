import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tests.llm.cases import frame, sentence
from tests.llm.test_near_copies import by_force
from tests.llm.test_scores_and_pii import LABELS, labelled
from trafficlens.llm import byte_bpe, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    docs, labels = labelled(300)
    rnd = random.Random(8)
    docs = [(i, t, None, f"s{i % 3}", len(t)) for i, t, *_ in docs]
    docs += [(1000 + i, docs[1 + 4 * i][1], None, "s1", 0) for i in range(20)]
    docs += [(2000 + i, sentence(rnd, 60) + f" mail jo{i}@mail.example.com", None, "s2", 0) for i in range(20)]
    docs += [(3000, None, None, None, None), (3001, "", None, None, 0), docs[2]]
    frame(spark, docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path), docs


def test_stages(spark, folder, tmp_path):
    path, docs = folder
    table = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, path).write.parquet(f"{tmp_path}/{name}")
        table = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "byte_bpe":
            assert table.columns == COLUMNS
        kept[name] = table.collect()
    # Toxic documents go, and only they.
    toxic = {i for i, t, *_ in docs if "blorgface" in (t or "") or "zugnut" in (t or "") or "vermwit" in (t or "")}
    assert {r.doc_id for r in kept["toxicity"]} == {d[0] for d in docs} - toxic
    # One of each group stays, and every document without words.
    rows = [tuple(r) for r in kept["toxicity"]]
    want = {r[2] for r in by_force(rows) if r[1]} | {3000, 3001}
    assert sorted(r.doc_id for r in kept["ngram_jaccard"]) == sorted(want)
    assert len(kept["pii"]) == len(want)
    assert not any("@mail" in (r.text or "") for r in kept["pii"])
    assert sum("<EMAIL>" in (r.text or "") for r in kept["pii"]) == 20
    copies = Counter(r.doc_id for r in kept["mixing"])
    assert set(copies) <= want and max(copies.values()) <= 3
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, special_tokens={},
                                  mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    texts = {r.doc_id: r.text or "" for r in kept["pii"]}
    assert len(kept["byte_bpe"]) == sum(copies.values())
    for r in kept["byte_bpe"]:
        assert list(r.ids) == reference.encode_ordinary(texts[r.doc_id]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_gives_the_last_stage(spark, folder):
    path, _ = folder
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "ids", "n_tokens", "decoded_sha256"] and out.count() > 0


def test_ten_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert names["pipeline"] is corpus_pipeline.run and set(queries.QUERIES) <= set(names)
