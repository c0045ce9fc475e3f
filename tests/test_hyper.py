import numpy as np
import pytest
from pyspark.sql import Row

from mnemospark.operators import hyper


def test_matching_is_the_sequential_one(spark):
    rng = np.random.default_rng(3)
    edges, want = [], set()
    for bank in "xyz":
        some = sorted({tuple(sorted(p)) for p in rng.integers(0, 30, (60, 2)).tolist() if p[0] != p[1]})
        edges += [(bank, a, b) for a, b in some]
        used = set()
        for a, b in some:
            if not used & {a, b}:
                used |= {a, b}
                want.add((bank, a, b))
    chain = [("chain", k, k + 1) for k in range(9)]
    want |= {("chain", k, k + 1) for k in range(0, 9, 2)}
    got = hyper.matched(spark.createDataFrame(edges + chain + chain[:1], "of string, a long, b long")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert hyper.matched(spark.createDataFrame([], "of string, a long, b long")).count() == 0


def _sequential(rows, least, differences):
    """First fit in listing order, one schema after another."""
    out = []
    for bank in sorted({r["bank"] for r in rows if r["bank"]}):
        own = sorted((r for r in rows if r["bank"] == bank and r["centroid"] and any(r["centroid"])), key=lambda r: r["id"])
        used = set()
        for i, x in enumerate(own):
            for y in own[i + 1 :]:
                if {x["id"], y["id"]} & used:
                    continue
                u, v = np.array(x["centroid"]), np.array(y["centroid"])
                keys = {k for k in {*x["properties"], *y["properties"]} if x["properties"].get(k) != y["properties"].get(k)}
                if round(1 - u @ v / np.sqrt(u @ u * (v @ v)), 9) <= 1 - least and len(keys) >= differences:
                    used |= {x["id"], y["id"]}
                    out.append((bank, x["id"], y["id"]))
    return sorted(out)


def test_pairs_against_first_fit(spark):
    rng = np.random.default_rng(8)
    rows = [{"bank": b, "id": f"s{k}", "centroid": rng.normal(size=3).round(1).tolist(), "properties": {"p": str(rng.integers(0, 2)), **({"q": "1"} if k % 3 else {})}} for b in ("b", "c") for k in range(25)]
    rows += [{"bank": "b", "id": "zero", "centroid": [0.0, 0.0, 0.0], "properties": {}}, {"bank": "b", "id": "none", "centroid": None, "properties": {}}, {"bank": None, "id": "s1", "centroid": [1.0, 0.0, 0.0], "properties": {}}]
    df = spark.createDataFrame(rows, "bank string, id string, centroid array<double>, properties map<string,string>")
    for least, differences in ((0.7, 1), (0.3, 2), (0.9, 0)):
        got = sorted((r.bank, r.a, r.b) for r in hyper.pair_up(df, "bank", "id", least, differences).collect())
        assert got == _sequential(rows, least, differences)
    assert hyper.pair_up(df.limit(0), "bank", "id").count() == 0


def test_parents_and_their_properties(spark):
    schemas = spark.createDataFrame([("b", "1", [1.0, 0.0], 4, "one"), ("b", "2", [0.8, 0.6], None, None), ("b", "3", [0.8, 0.6], 1, "far")], "of string, id string, centroid array<double>, evidence long, description string")

    def prop(id_, key, type_, **more):
        return Row(**{"of": "b", "id": id_} | {c.split()[0]: None for c in hyper.PROPERTY.split(", ")} | {"key": key, "type": type_, "count": 2} | more)

    properties = spark.createDataFrame(
        [
            prop("1", "hour", "numeric", mean=4.0, min=1.0, max=9.0), prop("2", "hour", "numeric", mean=5.0, min=3.0, max=11.0),
            prop("1", "day", "temporal", first_time="2024-01-02", last_time="2024-01-05"), prop("2", "day", "temporal", first_time="2024-01-01", last_time="2024-01-03"),
            prop("1", "same", "categorical", value="x"), prop("2", "same", "categorical", value="x"),
            prop("1", "mood", "categorical", value="good"), prop("2", "mood", "categorical", value="bad"),
            prop("1", "kind", "categorical", value="k"), prop("2", "kind", "numeric", mean=1.5, min=1.0, max=2.0),
            prop("1", "own", "numeric", mean=7.0, min=7.0, max=7.0),
        ],
        "of string, id string, " + hyper.PROPERTY,
    )
    parents, merged = hyper.hyper_schemas(schemas, properties)
    (p,) = parents.collect()
    assert (p.a, p.b, p.evidence, p.differing) == ("1", "2", 4, ["day", "hour", "kind", "mood", "own"])
    assert np.allclose(p.centroid, np.array([1.8, 0.6]) / np.hypot(1.8, 0.6)) and p.hyper_id.startswith("hyper-")
    assert p.description == "HyperSchema über 'one' und '' (differing keys: day, hour, kind, mood, own)"
    got = {r.key: r for r in merged.collect()}
    assert {r.hyper_id for r in got.values()} == {p.hyper_id}
    assert (got["hour"].mean, got["hour"].min, got["hour"].max, got["hour"]["count"]) == (4.5, 1, 11, 4)
    assert (got["day"].first_time, got["day"].last_time, got["day"].type) == ("2024-01-01", "2024-01-05", "temporal")
    assert (got["same"].value, got["same"].type, got["same"]["count"]) == ("x", "categorical", 4)
    assert (got["mood"].type, got["mood"].value) == ("categorical_set", "bad|good")
    assert (got["kind"].type, got["kind"].value) == ("categorical_set", "k|1.5")
    assert (got["own"].mean, got["own"]["count"]) == (7, 2)


def test_a_chain_is_matched_in_one_pass(spark):
    """Every edge waits for the one before it: this took a round of jobs a pair."""
    chain = spark.createDataFrame([("b", k, k + 1) for k in range(60)], "of string, a long, b long")
    spark.sparkContext.setJobGroup("chain", "chain")
    got = hyper.matched(chain).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.a for r in got) == list(range(0, 60, 2))
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain")) < 10


@pytest.mark.parametrize("least, blocks", [(0.5, (2, 5)), (0.97, (4,)), (0.7, ())])
def test_pairs_by_blocks_against_first_fit(spark, monkeypatch, least, blocks):
    """Schemas that find no partner in their blocks look further, at last in the whole bank; each pair is compared once."""
    monkeypatch.setattr(hyper, "BLOCKS", blocks)
    monkeypatch.setattr(hyper, "SLICE", 3)
    rng = np.random.default_rng(9)
    rows = [{"bank": b, "id": f"s{k:02}", "centroid": rng.normal(size=4).round(1).tolist(), "properties": {"p": str(rng.integers(0, 2))}} for b in ("b", "c") for k in range(30 if b == "b" else 3)]
    known, match = [], hyper.matched
    monkeypatch.setattr(hyper, "matched", lambda edges: known.append(edges) or match(edges))
    df = spark.createDataFrame(rows, "bank string, id string, centroid array<double>, properties map<string,string>")
    got = sorted((r.bank, r.a, r.b) for r in hyper.pair_up(df, "bank", "id", least).collect())
    assert got == _sequential(rows, least, 1)
    pairs = [(r.of, r.a, r.b) for r in known[-1].collect()]
    assert len(pairs) == len(set(pairs)) and len(known) > len(blocks) - 1


def test_alike_schemas_are_compared_until_they_have_a_partner(spark, monkeypatch):
    """300 schemas that are all alike have 44,850 pairs; a partner is found among the next few."""
    monkeypatch.setattr(hyper, "BLOCKS", (8, 64), raising=False)
    known, match = [], hyper.matched
    monkeypatch.setattr(hyper, "matched", lambda edges: known.append(edges) or match(edges))
    df = spark.createDataFrame([("b", f"s{k:03}", [1.0, k / 1000], {"p": str(k)}) for k in range(300)], "bank string, id string, centroid array<double>, properties map<string,string>")
    got = sorted((r.a, r.b) for r in hyper.pair_up(df, "bank", "id").collect())
    assert got == [(f"s{k:03}", f"s{k + 1:03}") for k in range(0, 300, 2)]
    assert known[-1].count() < 300 * 16
