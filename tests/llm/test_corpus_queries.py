"""The registered corpus queries: against their SQL where there is one, and the pipeline stage by stage."""

import cases
import duckdb
import pytest
from test_brute import brute_components, brute_repeats

import corpus_pipeline
from sitewise.llm.registry import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '{cases.SF}/{t}.parquet'")
    frame = QUERIES[name](spark, cases.SF)
    cur = con.execute(ORACLE[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r)) for r in frame.select(*columns).collect())


def test_near_duplicates_and_repeats_of_the_tables(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{cases.SF}/documents.parquet").collect()]
    want, _ = brute_components(texts)
    assert {r["doc_id"]: r["component_id"] for r in QUERIES["op3_fast_sketches"](spark, cases.SF).collect()} == want
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in QUERIES["op9_run_index"](spark, cases.SF).collect()}
    assert got == brute_repeats(texts)


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    names = docs.columns
    made, given = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        given = spark.createDataFrame(stage(spark, given, cases.SF).collect(), stage(spark, given, cases.SF).schema)
        made[name] = given
        assert name == "packing" or given.columns == names
    texts = {n: [(r["doc_id"], r["text"]) for r in f.collect()] for n, f in made.items() if n != "packing"}
    original = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {r["doc_id"] for r in spark.read.parquet(f"{cases.SF}/labels.parquet").where("quality = 1").collect()}
    kept = dict(texts["quality_rules"])
    assert all(kept[i] == original[i] for i in kept)
    long_enough = {i for i in good if len((original[i] or "").split()) >= 20}
    assert len(long_enough - set(kept)) <= 0.03 * len(long_enough)
    want, _ = brute_components(texts["quality_rules"], size=5)
    assert sorted(i for i, _ in texts["near_dedup"]) == sorted(set(want.values()))
    repeats = brute_repeats(texts["near_dedup"])
    for i, text in texts["suffix_dedup"]:
        assert len((text or "").encode()) in range(repeats[i][0] - repeats[i][1] - 3 * repeats[i][2] - 3, repeats[i][0] - repeats[i][1] + 1)
    cut = dict(texts["suffix_dedup"])
    assert all(cut[i] == t for i, t in texts["mixing"])
    assert len(texts["mixing"]) <= 2 * len(cut)
    words = sum(len((t or "").encode().split()) for _, t in texts["mixing"])
    assert abs(words - 1.5 * sum(len((t or "").encode().split()) for t in cut.values())) <= 4000
    assert sum(r["n_tokens"] for r in made["packing"].collect()) == words
    run = corpus_pipeline.run(spark, cases.SF)
    assert run.columns == made["packing"].columns and run.count() == made["packing"].count()
