"""Every operator and stage on awkward rows, on an empty table, and with columns of clashing names."""

import cases
import pytest
from pyspark.sql import functions as F

from sitewise.llm import (
    fingerprint,
    mixing,
    neardup,
    packing,
    quality_model,
    quality_rules,
    sharding,
    suffix,
    toxicity,
    warc,
)

LABELS = [(4, 1, 0), (5, 1, 1), (7, 0, 0), (7, 1, None), (10, 0, 1), (11, None, None), (None, 1, 1), (99, 1, 0)]

OPERATORS = {
    "packing": lambda d, s: packing.pack(d, capacity=64),
    "toxicity": lambda d, s: toxicity.toxicity(d, s),
    "neardup": lambda d, s: neardup.near_duplicates(d),
    "rules": lambda d, s: quality_rules.judge(d),
    "shards": lambda d, s: sharding.assign_shards(d, shards=3),
    "fingerprint": lambda d, s: fingerprint.fingerprint_versions(d),
    "mixing": lambda d, s: mixing.plan_mix(d),
    "suffix": lambda d, s: suffix.repeat_report(d),
    "quality": lambda d, s: quality_model.quality(d, s),
}
STAGES = {
    "rules": quality_rules.keep_good,
    "neardup": neardup.keep_first,
    "suffix": suffix.drop_repeats,
    "mixing": mixing.mix,
}


def plain(frame, drop=()):
    names = sorted(c for c in frame.columns if c not in drop)
    return sorted(map(repr, frame.select(*names).collect()))


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_clashing_names(spark, name):
    given = cases.labels(spark, LABELS)
    made = OPERATORS[name](cases.docs(spark), given)
    found = plain(made)
    rows = len(cases.rows())
    assert len({r for r in made.select("doc_id").toPandas()["doc_id"].fillna(-1)}) == 12
    assert len(found) == rows if name != "packing" else len(found) > rows
    if name not in ("rules",):
        assert plain(OPERATORS[name](cases.with_clashes(cases.docs(spark)), given)) == found
    else:
        assert len(plain(OPERATORS[name](cases.with_clashes(cases.docs(spark)), given))) == rows


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](cases.empty(spark), cases.labels(spark, [])).collect() == []
    assert OPERATORS[name](cases.empty(spark), cases.labels(spark, LABELS)).collect() == []


@pytest.mark.parametrize("name", STAGES)
def test_stage_keeps_columns(spark, name):
    docs = cases.docs(spark)
    made = STAGES[name](docs)
    assert made.columns == docs.columns
    assert [f.dataType for f in made.schema] == [f.dataType for f in docs.schema]
    clashing = STAGES[name](cases.with_clashes(docs))
    assert clashing.columns == cases.with_clashes(docs).columns
    assert plain(clashing.select(*docs.columns)) == plain(made)
    assert STAGES[name](cases.empty(spark)).collect() == []


def test_one_row(spark):
    one = cases.docs(spark, [(3, "only this text", "en", "a", 14)])
    no = cases.labels(spark, [])
    for name, operator in OPERATORS.items():
        assert operator(one, no).count() == 1, name
    made = fingerprint.fingerprint_versions(one).first()
    assert made["near_next"] == 1.0


def test_pages(spark):
    schema = "page_id long, url string, html string, size int, digest string"
    big = "<p>é</p>" * 300
    rows = [(1, None, None), (2, "u", ""), (3, "u\nv", big), (4, "w", big), (4, "w", big), (None, "n", big), (None, None, "x"), (7, "z", "é" * 49)]
    pages = spark.createDataFrame([(*r, 1, "d") for r in rows], schema)
    from sitewise.operators.staging import staging_path

    for segment in (50, 1000, 10**6):
        path = staging_path(spark, "warc")
        warc.write_archives(pages, path, segment_bytes=segment, records_per_file=3)
        got = warc.read_archives(spark, path)
        assert got.where("not intact").count() == 0
        found = sorted(got.select("page_id", "payload_bytes", "record_type", "refers_to").collect(), key=repr)
        want = [
            (1, 0, "response", None), (2, 0, "response", None), (3, 2700, "response", None), (4, 2700, "revisit", 3),
            (4, 2700, "revisit", 3), (None, 2700, "revisit", 3), (None, 1, "response", None), (7, 98, "response", None),
        ]
        assert [tuple(r) for r in found] == sorted(want, key=lambda r: repr(got.sparkSession.createDataFrame([r], "page_id long, payload_bytes long, record_type string, refers_to long").first()))
    none = staging_path(spark, "warc")
    warc.write_archives(pages.where(F.lit(False)), none)
    assert warc.read_archives(spark, none).collect() == []
