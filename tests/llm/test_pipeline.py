"""The pipeline's stages, and every corpus query, on the smallest data."""

import pytest
from compare import explain_difference, run_pair

from frames import awkward_texts, documents, prose

import corpus_pipeline
from parlance.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    left, right = run_pair(spark, duck, SF, QUERIES[name], SQL.get(name))
    assert left[1]
    assert explain_difference(left, right) is None


def test_stages(spark, tmp_path):
    near = prose(30, 500)
    secret = prose(31, 90) + ' password = "hunter2hunter2" ' + prose(32, 90)
    texts = [*awkward_texts(), near, near + " more", near, secret, prose(33, 200)]
    ids = list(range(len(texts)))
    docs = documents(spark, texts, ids, ["en"] * len(texts))
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        path = f"file://{tmp_path}/{i}-{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if i < 4:
            assert sorted(docs.columns) == sorted(columns)
        kept.append({r.doc_id: r.text for r in docs.collect()} if i < 4 else None)
    first, second, third, fourth, _ = kept
    n = len(awkward_texts())
    assert not {0, 1, 2, 3} & set(first) and {n, n + 1, n + 2, n + 3, n + 4} <= set(first)
    assert n in second and n + 2 not in second and not (7 in second and 6 in second)
    assert n + 4 in third and third[n + 4] == texts[n + 4]
    assert "hunter2" in third[n + 3] and "hunter2" not in fourth[n + 3] and "[SECRET]" in fourth[n + 3]
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(fourth)


def test_run(spark):
    pieces = corpus_pipeline.run(spark, SF)
    assert pieces.count() > 100
    assert pieces.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_stages_of_an_empty_table(spark):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), SF).count() == 0


def test_private_keys_are_masked_whole(spark):
    body = "\n".join("MIIEpAIBAAKCAQEA" + "Ab9+/x" * 8 for _ in range(20))
    whole = f"-----BEGIN RSA PRIVATE KEY-----\n{body}\nZz9=\n-----END RSA PRIVATE KEY-----"
    bare = f"-----BEGIN PRIVATE KEY-----\n{body}\nZz9="
    texts = [f"start {whole} middle - text {whole} end", f"start {bare}\nplain words", f"a {bare}\nthen words {whole} end"]
    got = {r.doc_id: r.text for r in corpus_pipeline.secrets_masked(spark, documents(spark, texts), SF).collect()}
    assert got == {0: "start [SECRET] middle - text [SECRET] end", 1: "start [SECRET]\nplain words", 2: "a [SECRET]\nthen words [SECRET] end"}


def test_language_without_a_profile(spark):
    """Where no row teaches a language, only texts without letters go."""
    docs = documents(spark, [prose(1, 50), None, "", "12 !!", "Ελληνικά"])
    assert sorted(r.doc_id for r in corpus_pipeline.known_language(spark, docs, SF).collect()) == [0, 4]
