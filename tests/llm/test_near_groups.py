"""Near-duplicates where groups are large, lie about the threshold, or have no ids of their own."""

import random

import cases
import pytest
from pyspark.sql import functions as F
from test_brute import brute_components, shingles

from sitewise.llm import neardup, quality_rules


def edits(base, rng, n):
    w = list(base)
    for at in rng.sample(range(len(w)), n):
        w[at] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def about_the_threshold(seed, n, words=150):
    """Copies of one text with up to ten words of their own each: pairs lie on both sides of 0.8."""
    rng = random.Random(seed)
    base = cases.words(seed, words).split()
    return [edits(base, rng, rng.randint(1, 10)) for _ in range(n)]


def frame(spark, texts):
    return cases.docs(spark, [(i, t, "en", "a", 0) for i, t in texts])


@pytest.mark.parametrize("size", [4, 5])
def test_groups_about_the_threshold(spark, size):
    texts = list(enumerate(about_the_threshold(1, 150) + about_the_threshold(2, 60, 60) + about_the_threshold(3, 40, 400)))
    random.Random(0).shuffle(texts)
    want, _ = brute_components(texts, size)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(frame(spark, texts), size).collect()}
    assert got == want
    assert len(set(want.values())) > 20


def test_listed_pairs_grow_with_the_group(spark):
    """Of the pairs of a group that lies about the threshold few are listed, and all that are linked."""
    texts = list(enumerate(about_the_threshold(5, 300)))
    sets = spark.createDataFrame(
        [(i, sorted(neardup.shingle_set(t).view("int64").tolist())) for i, t in texts], "cls long, elements array<long>"
    )
    buckets = sets.select(F.lit(7).cast("long").alias("key"), "cls", F.size("elements").cast("long").alias("n"))
    differences = neardup._differences(neardup._linkable(buckets, sets), sets)
    near = {r["cls"] for r in differences.where(9 * F.size("d") <= F.col("n") + F.col("pivot_n")).collect()}
    pivot = differences.first()["pivot"]
    labels = sets.select("cls", F.when(F.col("cls").isin([*near, pivot]), -1).otherwise(F.col("cls")).cast("long").alias("comp"))
    listed = neardup._meeting(differences.join(labels, "cls")).count()
    links = {(r["u"], r["v"]) for r in neardup._links_by_difference(differences, labels).collect()}
    plain = {i: shingles(t) for i, t in texts}
    want = set()
    for a in plain:
        for b in plain:
            if a < b and not {a, b} <= near | {pivot} and pivot not in (a, b):
                both = len(plain[a] & plain[b])
                if 100 * both >= 80 * (len(plain[a]) + len(plain[b]) - both):
                    want.add((a, b))
    assert links == want
    assert listed <= 20 * len(texts)


def test_rows_without_ids(spark):
    rng = random.Random(9)
    groups = [about_the_threshold(20 + g, 6) for g in range(4)]
    rows = [(None, t) for g in groups[:2] for t in g] + [(None, groups[0][0])] * 3
    rows += [(g * 100 + i if i % 2 else None, t) for g, texts in enumerate(groups[2:], 1) for i, t in enumerate(texts)]
    rows += [(500 + i if i % 2 else None, cases.words(900 + i, 40)) for i in range(10)]
    rows += [(7, cases.words(77, 50)), (7, cases.words(78, 50)), (7, cases.words(77, 50)), (None, None), (None, " "), (8, "")]
    rng.shuffle(rows)
    docs = cases.docs(spark, [(i, t, "en", "a", n) for n, (i, t) in enumerate(rows)])
    numbered, _ = brute_components([(n, t) for n, (_, t) in enumerate(rows)])
    members = {}
    for n, root in numbered.items():
        members.setdefault(root, []).append(n)
    kept = [(r["doc_id"], r["text"], r["n_chars"]) for r in neardup.keep_first(docs).collect()]
    bare = [n for n, (_, t) in enumerate(rows) if not (t or "").strip()]
    full = {root: m for root, m in members.items() if root not in bare}
    assert len(kept) == len(full) + len(bare)
    assert all(rows[n] == (i, t) for i, t, n in kept)
    for m in full.values():
        stay = [n for _, _, n in kept if n in m]
        ids = [rows[n][0] for n in m if rows[n][0] is not None]
        assert len(stay) == 1 and rows[stay[0]][0] == (min(ids) if ids else None)
    found = neardup.near_duplicates(docs)
    assert found.count() == len(rows) and found.where("kept is null").count() == 0
    smallest = {n: min((rows[k][0] for k in m if rows[k][0] is not None), default=None) for m in full.values() for n in m}
    got = sorted(((r["doc_id"], r["component_id"]) for r in found.where("n_shingles > 0").collect()), key=repr)
    assert got == sorted(((rows[n][0], smallest[n]) for m in full.values() for n in m), key=repr)


def test_many_equal_rows(spark):
    text = cases.words(5, 60)
    rows = [(3, text)] * 4000 + [(None, text)] * 4000 + [(1, edits(text.split(), random.Random(1), 1))]
    kept = neardup.keep_first(cases.docs(spark, [(i, t, None, None, 0) for i, t in rows])).collect()
    assert [r["doc_id"] for r in kept] == [1]


def test_bands_reach_rows_either_way(spark):
    docs = cases.docs(spark, [(i, cases.words(i, 90), ("en", "de", None)[i % 3], "a", 0) for i in range(60)])
    rows = quality_rules.measured(docs).withColumn("_script", F.col("_m.script")).withColumn("_group", F.lower("_row.lang"))
    own = quality_rules.bands(rows.where("_group is not null").select("_group", "_script", "_m.*"))
    names = [c for c in own.columns if c != "_group"]
    few, many = (sorted(map(repr, quality_rules.with_bands(rows, own, most=m).select("_row.doc_id", *names).collect())) for m in (10, 1))
    assert few == many and len(few) == 60


@pytest.mark.parametrize("names", [["_m", "_v", "_group", "_script", "_ref", "_row"], ["_key", "_own", "_kept", "_nth", "many", "cls"]])
def test_stages_keep_columns_named_like_their_own(spark, names):
    docs = cases.docs(spark).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    for stage in (quality_rules.keep_good, neardup.keep_first):
        made = stage(docs)
        assert made.columns == docs.columns
        assert made.select(*names).distinct().count() == 1 and made.first()[names[0]] == 0
        plain = stage(cases.docs(spark)).collect()
        assert sorted(map(repr, made.select(*cases.docs(spark).columns).collect())) == sorted(map(repr, plain))
