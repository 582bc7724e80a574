"""Fingerprints, archives, lexicon and additive model."""

import cases
import numpy as np
import pytest
from pyspark.sql import functions as F

from sitewise.llm import fingerprint, quality_model, toxicity, warc
from sitewise.llm.common import md5_number


@pytest.mark.parametrize("shared,a_only,b_only", [(3, 2, 1), (40, 0, 5), (5, 30, 60), (0, 0, 0), (300, 200, 90)])
def test_peeling_recovers_the_difference(spark, shared, a_only, b_only):
    frame = spark.range(1).select(
        F.transform(F.sequence(F.lit(0), F.lit(shared + a_only)), lambda x: md5_number(x.cast("string"))).alias("a"),
        F.transform(
            F.concat(F.sequence(F.lit(0), F.lit(shared)), F.sequence(F.lit(10_000), F.lit(10_000 + b_only))),
            lambda x: md5_number(x.cast("string")),
        ).alias("b"),
    )
    frame = frame.select("*", *[fingerprint.sketch(F.col(c), F.lit(1), 0).alias(f"s{c}") for c in "ab"])
    row = frame.select("a", "b", fingerprint.differing(F.col("a"), F.col("b"), F.col("sa"), F.col("sb")).alias("d")).first()
    a, b = set(row["a"]), set(row["b"])
    assert {(x["k"], x["n"]) for x in row["d"]} == {(k, 1) for k in a - b} | {(k, -1) for k in b - a}


def test_chunks_round_trip():
    for n in (0, 1, 10, 8192, 8193, 30000):
        body = bytes(i % 251 for i in range(n))
        assert warc.unchunked(warc.chunked(body, 100)) == body
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


def test_missing_or_changed_segments_are_seen(spark):
    payload = b"<html>" + b"x" * 5000
    digest = __import__("hashlib").sha256(payload).hexdigest()
    records = warc.page_records(5, "u", payload, digest, None, False, 700)
    assert len(records) > 3

    def intact(some):
        data = b"".join(r + warc.END for r in some)
        rows = [warc._parsed_row(f, b) for f, b in warc.parse_records(data)]
        frame = spark.createDataFrame([tuple(r[k] for k in ORDER) for r in rows], warc.PARSED)
        return warc.joined(frame).first()

    ORDER = ["id", "page_id", "type", "refers", "digest", "segment", "total", "payload_bytes", "payload_digest", "intact", "piece"]
    good = intact(records[::-1])
    assert good["intact"] and good["payload_bytes"] == len(payload) and good["page_id"] == 5
    assert not intact(records[:1] + records[2:])["intact"]
    assert not intact(records[:-1])["intact"]
    assert not intact([records[0].replace(b"xxxx", b"yxxx", 1), *records[1:]])["intact"]


def test_folding():
    assert toxicity.folded_words("STΥPID, l0$er! Ｓcum") == ["stupid", "loser", "scum"]
    assert toxicity.folded_words("id​iot іdiоt") == ["idiot", "idiot"]


def test_exceptions_and_length():
    model = toxicity.ToxicityModel({"clown": 4.0, "clownf": 5.0}, ("the clown fish",), (-4.0, 2.0, 1.0))
    machine = model.automaton()
    assert toxicity.hits(machine, "the clown fish".split())[0] == {}
    assert list(toxicity.hits(machine, "a clownfight here".split())[0].values()) == [5.0]
    short, long = (toxicity.score_of(model, 4.0, n) for n in (5, 5000))
    assert short > long


def test_toxicity_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, given = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.toxicity(docs, given).join(given, "doc_id").where("held_out")
    right = out.where("predicted = toxic").count() / out.count()
    assert right >= 0.9


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    docs, given = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = quality_model.quality(docs, given).join(given, "doc_id").where("held_out")
    assert out.where("predicted = quality").count() / out.count() >= 0.95


def test_pairs_are_learned():
    rng = np.random.default_rng(1)
    x = rng.uniform(0, 1, (3000, len(quality_model.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality_model.fit(x[:2000], y[:2000], np.ones(2000))
    assert (0, 1) in model.pairs
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    raw = model.start + sum(t[np.searchsorted(e, x[:, j])] for j, (e, t) in enumerate(zip(model.edges, model.tables, strict=True)))
    coarse = [np.searchsorted(e, x[:, j]) for j, e in enumerate(model.pair_edges)]
    raw = raw + sum(t[coarse[i], coarse[j]] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
    assert np.allclose(raw, model.raw(x))


def test_one_label_only(spark):
    docs = cases.docs(spark, [(i, cases.words(i, 30), "en", "a", 0) for i in range(30)])
    given = cases.labels(spark, [(i, 1, 0) for i in range(30)])
    assert {r["predicted"] for r in quality_model.quality(docs, given).collect()} == {1}
    assert {r["predicted"] for r in toxicity.toxicity(docs, given).collect()} == {0}
