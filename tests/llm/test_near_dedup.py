import random

import pytest

from mnemospark.llm import common, near_dedup
from mnemospark.llm.components import components
from tests.llm.brute import near_components


def rows_of(spark, docs):
    return spark.createDataFrame(docs, "doc_id long, text string")


def check(spark, docs):
    got = {r.doc_id: r for r in near_dedup.find(rows_of(spark, docs)).collect()}
    component, n = near_components(docs)
    assert {d: r.component_id for d, r in got.items()} == component
    assert {d: r.n_shingles for d, r in got.items()} == n
    assert all(r.kept == (d == r.component_id) for d, r in got.items())


def edited(rng, base, share):
    return " ".join(rng.choice("xyz") + str(rng.randrange(10**6)) if rng.random() < share else w for w in base)


@pytest.fixture(scope="module")
def group():
    """A base text with copies of all degrees of likeness, so that some links only lead over others."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    docs = [(1000 + k, edited(rng, base, share)) for k, share in enumerate([0.01] * 40 + [0.025] * 60 + [0.04] * 40 + [0.06] * 20)]
    return docs + [(1, " ".join(base)), (2, " ".join(base).upper())]


def test_against_all_pairs(spark, group, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS_PER_ROW", 10**9)  # one turn of pivots, then the residual comparison
    check(spark, group)


def test_blocks_of_a_large_bucket(spark, group, monkeypatch):
    """The residual comparison by pairs of blocks, and nothing broadcast by its size."""
    monkeypatch.setattr(near_dedup, "PAIRS_PER_ROW", 10**9)
    monkeypatch.setattr(near_dedup, "PART", 16)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    rng = random.Random(8)
    shared = [f"u{rng.randrange(900)}" for _ in range(60)]  # a passage that many texts share, without links
    check(spark, group + [(5000 + k, " ".join(shared + [f"q{rng.randrange(10**6)}" for _ in range(35)])) for k in range(60)])


def test_several_pivots_and_parts(spark, group, monkeypatch):
    monkeypatch.setattr(near_dedup, "PAIRS_PER_ROW", 0)
    monkeypatch.setattr(near_dedup, "PART", 16)
    check(spark, group)


def test_edge_cases(spark):
    long = " ".join(f"t{k}" for k in range(30_000))
    docs = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One TWO"), (6, "two one"), (7, long), (8, long + " x"), (9, "a b c d e"), (10, "a b c d e"), (11, "a\x85b c d e f"), (12, "É b c d e"), (13, "é b c d e")]
    check(spark, docs)


def test_empty_repeated_and_null_ids(spark):
    assert near_dedup.find(rows_of(spark, [])).count() == 0
    got = near_dedup.find(rows_of(spark, [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "alone here today with no one")])).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in got) == [("5", "5", True), ("5", "5", True), ("None", "5", False), ("None", "None", True)]


def test_keep_one_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "x", 1), (2, "a b c d e f", "y", 2)], "doc_id long, text string, component_id string, rep int")
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns and [r.doc_id for r in out.collect()] == [1]


def test_keep_one_without_ids(spark):
    df = rows_of(spark, [(5, "a b c d e f"), (None, "a b c d e f"), (None, "alone here today with no one"), (None, None)])
    assert sorted(str(r.text) for r in near_dedup.keep_one(df).collect()) == ["None", "a b c d e f", "alone here today with no one"]


def test_components_of_a_path(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 90), (90, 95)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(61)}, 90: 90, 95: 90, 100: 90}
