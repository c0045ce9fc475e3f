import json
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.operators import clustering, consolidation, entities, graph, lifecycle, links, ranking, retrieval, texts, vector_index
from mnemospark.streaming import sessions

LINKS = "src string, dst string, type string, weight double"


def test_push_one_hop(spark):
    seeds = spark.createDataFrame([(1, "a", 3.0)], "query_id long, node string, score double")
    edges = spark.createDataFrame([("a", "b", "semantic", 0.8), ("a", "c", "semantic", 0.4), ("a", "d", "entity", 1.0)], LINKS)
    got = {r.node: r.mass for r in graph.push(seeds, edges, ("semantic",)).collect()}
    assert got["a"] == pytest.approx(0.15) and got["b"] == pytest.approx(0.85 * 2 / 3) and got["c"] == pytest.approx(0.85 / 3) and "d" not in got


def test_push_without_edges_or_seeds(spark):
    seeds = spark.createDataFrame([(1, "a", 0.0), (1, "b", 0.0)], "query_id long, node string, score double")
    none = spark.createDataFrame([], LINKS)
    assert {r.node: r.mass for r in graph.push(seeds, none, ("semantic",)).collect()} == pytest.approx({"a": 0.075, "b": 0.075})
    assert graph.push(seeds.limit(0), none, ("semantic", "semantic")).count() == 0


def test_spread_against_a_walk(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b), "causes" if rng.random() < 0.2 else "semantic", float(rng.random())) for a, b in rng.integers(0, 30, (120, 2)) if a != b]
    best, level, depth = {0: (1.0, 0)}, {0: 1.0}, 0
    while level and depth < 3:
        depth += 1
        step = {}
        for s, d, t, w in edges:
            if s in level and d not in best:
                v = min(1.0, level[s] * w * 0.8 * (2.0 if t == "causes" else 1.0))
                if v >= 0.1:
                    step[d] = max(step.get(d, 0), v)
        best |= {n: (v, depth) for n, v in step.items()}
        level = step
    entries = spark.createDataFrame([(1, 0, 1.0)], "query_id long, node long, score double")
    got = {r.node: (pytest.approx(r.activation), r.depth) for r in graph.spread(entries, spark.createDataFrame(edges, "src long, dst long, type string, weight double")).collect()}
    assert got == best


def test_vector_search_against_all(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    got = retrieval.vector_search(df, df.filter("id % 10 = 0"), "id", "v", 4, block=16).collect()
    u = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for q in range(0, 60, 10):
        want = sorted((j for j in range(60) if j != q), key=lambda j: (-round(float(u[q] @ u[j]), 9), j))[:4]
        assert [int(r.item_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == str(q)] == want


def test_index_against_exact_search(spark, tmp_path):
    """Banks of one cell and of many, zero vectors, ties, and a threshold; grouped vectors spare most cells."""
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(20, 8))
    v = np.concatenate([centres[np.arange(400) % 20] + 0.05 * rng.normal(size=(400, 8)), rng.normal(size=(30, 8))])
    v[17] = v[37]
    v[5] = 0
    df = spark.createDataFrame([("b" if k < 400 else "c", k, x.tolist()) for k, x in enumerate(v)] + [("b", 999, None)], "bank string, id long, v array<double>")
    index = vector_index.build(df, "id", "v", "bank", cell=20, folder=str(tmp_path / "index"))
    asked = df.filter("id % 10 = 7")
    key = lambda rows: sorted((r.query_id, r["rank"], r.item_id, round(r.score, 7)) for r in rows.collect())
    for least in (-1.0, 0.8):
        assert key(index.search(asked, "id", "v", 6, least, "bank", probes=1)) == key(retrieval.vector_search(df.filter("id <> 5"), asked, "id", "v", 6, least, bank="bank"))
    n, read = index.cells.count(), []
    index._found = lambda rows, *a, f=index._found: (read.append(rows.count()), f(rows, *a))[1]
    index.search(asked.filter("bank = 'b'"), "id", "v", 6, bank="bank", probes=1).collect()
    assert n > 10 and sum(read) < 0.5 * n * asked.filter("bank = 'b'").count()


def test_temporal_links_cap(spark):
    at = datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, k, at + timedelta(hours=k)) for k in range(30)] + [(2, 99, at)], "bank long, id long, ts timestamp")
    got = links.temporal_links(df, df, "bank", "id", "ts").filter("a = 0").collect()
    assert sorted(r.b for r in got) == list(range(15, 25)) and min(r.weight for r in got) == 0.3


def test_latest_within_writes_few_rows(spark):
    """Ties, both ends of the window, several banks, and a bin that holds most units."""
    rng = np.random.default_rng(9)
    at = datetime(2024, 1, 1)
    rows = [("b", k, at + timedelta(minutes=int(m))) for k, m in enumerate(rng.integers(0, 4000, 300))] + [("c", 900, at), ("c", 901, at + timedelta(hours=24)), ("c", 902, at + timedelta(hours=48, seconds=1))]
    rows += [("d", 1000 + k, at + timedelta(seconds=k % 5)) for k in range(200)] + [("d", 5000, None)]
    df = spark.createDataFrame(rows, "bank string, id long, ts timestamp")
    got = {}
    for r in links.latest_within(df, df, "bank", "id", "ts", 86400, 10).collect():
        got.setdefault((r.bank, r.a), []).append((r["rank"], r.b))
    for b, i, t in rows:
        near = sorted((x for x in rows if t and x[2] and x[0] == b and x[1] != i and abs((x[2] - t).total_seconds()) <= 86400), key=lambda x: (-x[2].timestamp(), x[1]))[:10]
        assert [x for _, x in sorted(got.get((b, i), []))] == [x[1] for x in near]
    many = spark.range(20_000).select(F.lit("b").alias("bank"), "id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") % 3000).alias("ts"))
    assert links.latest_within(many, many, "bank", "id", "ts", 86400, 10).count() == 200_000


def test_time_windows_against_all_units(spark):
    """Very long and very short ranges, single dates, open and reversed ones, and windows from a moment to centuries."""
    rng = np.random.default_rng(10)
    zero = datetime(2020, 1, 1)
    when = lambda hours: zero + timedelta(microseconds=int(hours * 3.6e9))
    units = []
    for k in range(400):
        a, span = float(rng.uniform(-90_000, 90_000)), float(10 ** rng.uniform(-4, 5))
        kind = rng.integers(0, 6)
        start, end = (when(a) if kind != 1 else None), (when(a + span) if kind not in (0, 2) else None)
        if kind == 5:
            start, end = end, start
        units.append(("bc"[k % 2], k, start, end, when(a + 7) if kind in (1, 2) else None))
    units += [("b", 900, None, None, None), ("b", 901, when(-1e5), when(1e5), None), ("b", 902, when(5.0), when(5.0), None)]
    windows = [("b", 0, when(-2e5), when(2e5)), ("c", 1, when(5.0), when(5.0)), ("b", 2, when(4.9), when(5.1)), ("b", 3, when(9), when(8)), ("b", 4, None, when(8)), ("b", 5, when(5.0), when(5.0))]
    windows += [("bc"[k % 2], k, when(a), when(a + 10 ** rng.uniform(-3, 4.5))) for k, a in enumerate(rng.uniform(-90_000, 90_000, 40), 10)]
    u = spark.createDataFrame(units, "bank string, id long, s timestamp, e timestamp, m timestamp")
    q = spark.createDataFrame(windows, "bank string, query_id long, low timestamp, high timestamp")
    found = retrieval.temporal_entries(u, q, 7, "id", "s", "e", "m", bank="bank")
    plan = found._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    got = {}
    for r in found.collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.unit_id))
    for bank, k, low, high in windows:
        inside = lambda t: t is not None and low <= t <= high  # noqa: E731, B023
        met = [x for x in units if x[0] == bank and low and low <= high and (x[2] and x[3] and x[2] <= high and x[3] >= low or inside(x[2]) or inside(x[3]) or inside(x[4]))]
        met.sort(key=lambda x: (-(x[2] or x[4] or x[3]).timestamp(), x[1]))
        assert [i for _, i in sorted(got.get(k, []))] == [x[1] for x in met[:7]], k


def test_long_ranges_stand_at_few_nodes(spark):
    """Every cell of a range once, at a few tens of nodes; a range of seven years had some hundreds."""
    from mnemospark.functions import time

    ranges = [(0, -3, -3), (1, 5, 4), (2, -5, 6), (3, 0, 255), (4, 1, 51_000), (5, -70_001, 13), (6, 1021, 1026), (7, 4**7, 4**8 - 1)]
    got = {}
    for r in time.covered(spark.createDataFrame(ranges, "id int, first long, last long"), "first", "last", retrieval.RANGE_BITS).collect():
        got.setdefault(r.id, []).append((r.level, r.node))
    for k, first, last in ranges:
        nodes = got.get(k, [])
        cells = sorted(c for level, n in nodes for c in range(n << retrieval.RANGE_BITS * level, (n + 1) << retrieval.RANGE_BITS * level))
        assert cells == list(range(first, last + 1)) and len(nodes) <= 60
    assert got[7] == [(7, 1), (7, 2), (7, 3)]
    at = {(x.level, x.node) for x in spark.range(1).select(F.explode(time.above(F.lit(777).cast("long"), retrieval.RANGE_BITS)).alias("n")).select("n.*").collect()}
    assert len(at & set(got[4])) == 1 and not at & set(got[3])


def test_semantic_links_of_a_bank(spark):
    df = spark.createDataFrame([("b", "x", [1.0, 0.0]), ("b", "y", [0.8, 0.6]), ("b", "z", [0.0, 1.0]), ("c", "w", [1.0, 0.0])], "bank string, id string, v array<double>")
    got = {(r.a, r.b): round(r.weight, 6) for r in links.semantic_links(df.filter("id in ('x', 'w')"), df, "bank", "id", "v").collect()}
    assert got == {("x", "y"): 0.8}


@pytest.mark.parametrize(
    "new_score, old_score, new_strength, old_strength, new_day, old_day, contradicts, action, winner",
    [
        (0.9, 0.4, 0.1, 0.9, 1, 2, True, "contradiction_link", "n"),
        (0.4, 0.9, 0.9, 0.1, 2, 1, True, "keep_existing", "o"),
        (0.5, 0.5, 0.0, 0.9, 2, 1, True, "contradiction_link", "n"),
        (0.5, 0.5, 0.9, 0.0, 1, 1, True, "keep_existing", "o"),
        (None, 0.0, 0.9, 0.0, None, 1, True, "keep_existing", "o"),
        (0.5, 0.5, 0.9, 0.0, 1, None, True, "contradiction_link", "n"),
        (0.1, 0.9, 0.9, 0.1, 1, 2, False, "replace", "n"),
        (0.1, 0.9, 0.5, 0.5, 1, 2, False, "replace", "n"),
        (0.9, 0.1, 0.1, 0.9, 2, 1, False, "merge", "o"),
        (0.9, 0.1, None, None, 2, 1, None, "replace", "n"),
    ],
)
def test_conflicts(spark, new_score, old_score, new_strength, old_strength, new_day, old_day, contradicts, action, winner):
    at = lambda d: d and datetime(2024, 1, d)
    pair = [("n", "o", new_score, old_score, new_strength, old_strength, at(new_day), at(old_day), contradicts)]
    (r,) = consolidation.resolve_conflicts(spark.createDataFrame(pair, "new_id string, old_id string, new_score double, old_score double, new_strength double, old_strength double, new_at timestamp, old_at timestamp, contradicts boolean")).collect()
    assert (r.action, r.winner, r.loser) == (action, winner, "no".replace(winner, ""))


def test_cohesion_is_the_mean_of_pairs(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(9, 5))
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = np.mean([u[i] @ u[j] for i in range(9) for j in range(i)])
    df = spark.createDataFrame([("x", r.tolist()) for r in v] + [("y", [1.0, 0.0, 0.0, 0.0, 0.0])], "g string, v array<double>")
    got = {r.g: r.cohesion for r in consolidation.cohesion(df, ["g"], "v").collect()}
    assert got["x"] == pytest.approx(want) and got["y"] == 1.0


def test_properties(spark):
    rows = [(1, [f"hour:{h}", "mood:good" if h < 46 else "mood:bad", "at:2024-01-0" + str(h - 39), "mixed:" + ("1" if h % 2 else "2.5"), "plain"]) for h in range(40, 48)]
    got = {r.key: r for r in consolidation.properties(spark.createDataFrame(rows, "b int, tags array<string>"), ["b"], "tags").collect()}
    assert (got["hour"].min, got["hour"].max, got["hour"].mean) == (40, 47, 44) and got["hour"].type == "numeric"
    assert (got["mood"].value, got["mood"].confidence) == ("good", 0.75) and got["_keywords"].confidence == 1
    assert (got["at"].type, got["at"].first_time, got["at"].last_time) == ("temporal", "2024-01-01", "2024-01-08")
    assert got["mixed"].mean == pytest.approx(1.75)


def test_complete_linkage_against_all_pairs():
    rng = np.random.default_rng(5)
    for n, cut in ((1, 0.5), (2, 2.0), (60, 0.6), (60, 2.0)):
        v = rng.normal(size=(n, 6)).round(1)
        v[n // 2 :] = v[: n - n // 2]  # ties
        u = v / np.linalg.norm(v, axis=1, keepdims=True)
        d, groups = 1 - u @ u.T, [[k] for k in range(n)]
        while len(groups) > 1:
            far = {(a, b): max(d[x, y] for x in groups[a] for y in groups[b]) for a in range(len(groups)) for b in range(a + 1, len(groups))}
            (a, b), gap = min(far.items(), key=lambda e: e[1])
            if gap > cut:
                break
            groups[a] += groups.pop(b)
        got = consolidation.complete_linkage(v, cut)
        assert sorted(len(g) for g in groups) == sorted(np.unique(got, return_counts=True)[1])
        assert max((d[x, y] for x in range(n) for y in range(n) if got[x] == got[y]), default=0) <= cut


def whole_bank(rows, cut, least=3):
    """Clusters of each bank by the sequential method on all of its rows."""
    out = {}
    for bank in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == bank and r[2] is not None and any(r[2])), key=lambda r: r[1])
        label = consolidation.complete_linkage(np.array([r[2] for r in own], float).reshape(len(own), -1), cut) if own else []
        groups = {}
        for r, x in zip(own, label, strict=True):
            groups.setdefault(x, []).append(r[1])
        out |= {(bank, i): min(g) for g in groups.values() if len(g) >= least for i in g}
    return out


def clustered(spark, rows, cut, most, **settings):
    df = spark.createDataFrame(rows, "bank string, id long, v array<double>")
    got = consolidation.clusters(df, "bank", "id", "v", cut, most=most, **settings).collect()
    assert len(got) == len({(r.bank, r.id) for r in got})
    return {(r.bank, r.id): r.cluster for r in got}


@pytest.mark.parametrize("most", [5, 1000])
def test_clusters_do_not_depend_on_how_a_bank_is_dealt(spark, most):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 12))
    rows = [("b", k, (centres[k % 40] + 0.05 * rng.normal(size=12)).tolist()) for k in range(240)]  # 40 clusters of 6
    got = clustered(spark, rows, 0.25, most)
    assert len(got) == 240 and set(Counter(got.values()).values()) == {6} and got == whole_bank(rows, 0.25)


@pytest.mark.parametrize("most, cell, block", [(1, 10, 8), (1000, 10, 8)])
def test_clusters_against_the_whole_bank(spark, monkeypatch, most, cell, block):
    """Ties, copies, chains, banks of all sizes, null banks and vectors; pairs by cells of ten."""
    rng = np.random.default_rng(7)
    v = rng.normal(size=(40, 4)).round(1)
    v[30:] = v[:10]
    rows = [("b", k, x.tolist()) for k, x in enumerate(v)] + [("c", k, [1.0, 0.0, 0.0, 0.0]) for k in range(5)] + [(None, 200 + k, x.tolist()) for k, x in enumerate(v[:15])]
    rows += [("d", k, [float(np.cos(k / 9)), float(np.sin(k / 9)), 0.0, 0.0]) for k in range(25)] + [("e", 1, None), ("e", 2, [0.0] * 4), ("e", 3, [0.0] * 4), ("e", 4, [0.0] * 4)]
    monkeypatch.setattr(clustering, "within", lambda points, cut, f=clustering.within: f(points, cut, cell, block))
    assert clustered(spark, rows, 0.3, most) == whole_bank(rows, 0.3)
    if most > 1:
        assert clustered(spark, rows[:1], 0.3, most) == {} and clustered(spark, rows[:1], 0.3, most, least=1) == {("b", 0): 0}


def test_pairs_within_the_cut_are_found_once(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(12, 16))
    v = np.concatenate([centres[np.arange(600) % 12] + 0.2 * rng.normal(size=(600, 16))])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if round(1 - float(u[i] @ u[j]), 9) <= 0.2}
    points = spark.createDataFrame([("=b", k, x.tolist()) for k, x in enumerate(v)], "of string, node long, v array<double>")
    got = [(r.a, r.b) for r in clustering.within(points, 0.2, cell=40, block=32).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_clusters_write_no_pairs(spark, tmp_path):
    """700 rows within the cut of each other have 244,650 pairs, which were written; the rows alone are under a megabyte."""
    rng = np.random.default_rng(13)
    rows = [("b", k, [1.0, *x]) for k, x in enumerate(rng.normal(scale=0.01, size=(700, 3)).tolist())]
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    try:
        assert clustered(spark, rows, 0.25, 1000) == {("b", k): 0 for k in range(700)}
    finally:
        spark.sparkContext.setCheckpointDir(before.removeprefix("file:"))
    assert sum(f.stat().st_size for f in tmp_path.rglob("*") if f.is_file()) < 1 << 20


def test_merges_in_rounds_are_the_sequential_ones(monkeypatch):
    rng = np.random.default_rng(14)
    for k in range(60):
        v = rng.normal(size=(int(rng.integers(1, 50)), int(rng.integers(2, 6)))).round(k % 3)  # ties
        v[(v == 0).all(1)] = 1
        m, cut = v / np.linalg.norm(v, axis=1, keepdims=True), (0.05, 0.3, 0.75, 2.0)[k % 4]
        monkeypatch.setattr(clustering, "PRODUCTS", (1, 60, 1 << 19)[k % 3])
        monkeypatch.setattr(clustering, "RANKS", (1, 2, 16)[k // 3 % 3])
        assert (clustering.linked(m, np.arange(len(m)), cut) == clustering.complete_linkage(m, cut)).all()


@pytest.mark.parametrize("spread", [0.5, 100])
def test_large_banks_by_blocks_and_cells(spark, monkeypatch, spread):
    """Rounds by many tasks until 30 rows are left: blocks of 8 in one cell, and in cells of twelve."""
    for name, x in (("CELL", 12), ("WIDE", 8), ("SPREAD", spread)):
        monkeypatch.setattr(clustering, name, x)
    rng = np.random.default_rng(15)
    centres = rng.normal(size=(9, 6))
    rows = [("b", 3 * k, (centres[k % 9] + 0.25 * rng.normal(size=6)).round(1).tolist()) for k in range(90)] + [("c", k, x.tolist()) for k, x in enumerate(rng.normal(size=(20, 6)))]
    want = whole_bank(rows, 0.2)
    assert len(want) > 40 and clustered(spark, rows, 0.2, 30) == want


def test_new_entity_links(spark):
    schema = "unit string, entity string, at int"
    new = spark.createDataFrame([("n1", "e", 10), ("n2", "e", 11), ("n3", "e", 12), ("n1", "f", 10)], schema)
    stored = spark.createDataFrame([(f"s{k}", "e", k) for k in range(6)] + [("s9", "g", 9)], schema)
    got = {(r.a, r.b, r.entity) for r in links.new_entity_links(new, stored, "unit", "entity", [F.desc("at")], 2).collect()}
    pairs = {("n2", "n3"), *((n, s) for n in ("n1", "n2", "n3") for s in ("s4", "s5"))}
    assert got == {(a, b, "e") for x, y in pairs for a, b in ((x, y), (y, x))}
    assert links.new_entity_links(new.limit(0), stored, "unit", "entity", [F.desc("at")]).count() == 0


def test_entity_links_are_not_compared_again(spark):
    rows = [(f"u{k}", "e", k) for k in range(6)] + [("u5", "e", 5), ("v", "f", 1), (None, "f", 2), ("x", None, 1), ("y", None, 2)]
    found = links.entity_links(spark.createDataFrame(rows, "unit string, entity string, at int"), "unit", "entity", [F.desc("at")], 3)
    assert "Aggregate [a#" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r.a, r.b, r.entity) for r in found.collect()) == [("u4", "u5", "e"), ("u5", "u4", "e")]  # u5 was said twice


@pytest.mark.parametrize("item", ["many", "few"])
def test_co_occurrences_are_dealt_by_their_number(spark, monkeypatch, item):
    """Rows of 20 pairs a task: both the parts of entity_cooccurrence and the suppliers of co_activation."""
    monkeypatch.setattr(links, "PAIRS_PER_TASK", 20)
    rows = [(g, (g * 7 + k) % (50 if item == "many" else 5)) for g in range(40) for k in range(4)] + [(None, 1), (None, 2), (3, 21), (3, 21)]
    found = links.co_occurrences(spark.createDataFrame(rows, f"g long, {item} long"), "g", item)
    assert "RepartitionByExpression [g#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and "], 13" in plan
    want = Counter((a, b) for g in range(40) for a in {i for h, i in rows if h == g} for b in {i for h, i in rows if h == g} if a < b)
    assert {(r.a, r.b): r.n for r in found.collect()} == want


def test_workers_hold_one_pair_of_blocks(spark, monkeypatch):
    """Search by blocks, by cells and clusters get a pair of blocks at a time; an Arrow batch held up to 10,000 pairs before."""
    seen = []
    rng = np.random.default_rng(12)
    df = spark.createDataFrame([(int(k), "b", [float(x) for x in v]) for k, v in enumerate(rng.normal(size=(300, 4)))], "id long, bank string, v array<double>").cache()
    monkeypatch.setattr(retrieval, "QUERY_BYTES", 0)
    found = retrieval.vector_search(df, df, "id", "v", 3, block=64, bank="bank")
    seen.append(found._jdf.queryExecution().optimizedPlan().toString())
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    by_cell = vector_index.build(df, "id", "v", bank="bank", cell=50).search(df, "id", "v", 3, bank="bank")
    seen.append(by_cell._jdf.queryExecution().optimizedPlan().toString())
    near = clustering.within(df.select(F.col("bank").alias("of"), F.col("id").alias("node"), "v"), 0.1, cell=50, block=16)
    seen.append(near._jdf.queryExecution().optimizedPlan().toString())
    assert all("FlatMapCoGroupsInArrow" in p and "MapInArrow" not in p for p in seen)
    rows = lambda x: sorted((int(r.query_id), r["rank"], int(r.item_id)) for r in x.collect())
    m = np.array([r.v for r in df.orderBy("id").collect()])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    np.fill_diagonal(s, -9)
    want = sorted((q, k + 1, int(i)) for q in range(300) for k, i in enumerate(np.lexsort((np.arange(300), -s[q].round(9)))[:3]))
    assert rows(found) == want and rows(by_cell) == want
    assert sorted((r.a, r.b) for r in near.collect()) == [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(np.round(1 - s, 9) <= 0.1, 1)), strict=True)]


def test_complete_linkage():
    rng = np.random.default_rng(0)
    v = np.concatenate([c + rng.normal(scale=0.01, size=(10, 6)) for c in np.eye(6)[:3]])
    labels = consolidation.complete_linkage(v, 0.25)
    assert len(set(labels)) == 3 and all(len(set(labels[k * 10 : k * 10 + 10])) == 1 for k in range(3))


def test_resolution_and_candidates(spark):
    at = datetime(2024, 1, 1)
    known = spark.createDataFrame([("b", 1, "Anna Berg", at), ("b", 2, "Peter", at), ("c", 3, "Anna Berg", at), ("b", 4, "Al", at)], "bank string, entity_id long, canonical_name string, last_seen timestamp")
    said = spark.createDataFrame([("b", 10, "anna berg", ["Peter"], at), ("b", 11, "Zoe", [], at), ("b", 12, "Dr Peter Ustinov and friends of the house", [], at + timedelta(days=30)), ("b", 13, "al", [], at)], "bank string, mention_id long, name string, nearby array<string>, seen timestamp")
    company = spark.createDataFrame([(1, ["peter"])], "entity_id long, names array<string>")
    got = {r.mention_id: r.entity_id for r in entities.resolve(said, known, company).collect()}
    assert got == {10: 1, 11: None, 12: None, 13: 4}
    pairs = {(r.mention_id, r.entity_id) for r in entities.candidates(said, known).collect()}
    assert pairs == {(10, 1), (12, 2), (13, 4)}


def test_copies_of_a_name_are_one_candidate(spark, monkeypatch):
    at, pairs, found = datetime(2024, 1, 1), [], entities.candidates
    monkeypatch.setattr(entities, "candidates", lambda m, e: pairs.append(found(m, e)) or pairs[-1])
    known = spark.createDataFrame([("b", k, "Hot Bolt", at if k % 2 else at - timedelta(days=3), ["eve"] if k == 38 else None) for k in range(2, 42)], "bank string, entity_id long, canonical_name string, last_seen timestamp, names array<string>")
    said = spark.createDataFrame([("b", 100 + k, "hot bolt", None if k == 7 else ["Eve"] if k == 8 else [], None if k == 9 else at) for k in range(40)] + [("b", 200, None, [], at)], "bank string, mention_id long, name string, nearby array<string>, seen timestamp")
    got = {r.mention_id: (r.entity_id, r.score and round(r.score, 6)) for r in entities.resolve(said, known.drop("names"), known.select("entity_id", "names").filter("names is not null"), least=0.4).collect()}
    near, far = 0.5 + 0.2, 0.5 + 0.3 + 0.2 * (1 - 3 / 7)
    assert got == {100 + k: (38, round(far, 6)) if k == 8 else (2, 0.5) if k == 9 else (3, near) for k in range(40)} | {200: (None, None)}
    assert pairs[0].count() <= 12  # 4 kinds of mentions, 3 of entities; 1,600 pairs before


def test_facts_come_a_few_texts_at_a_time(spark):
    """Chunks and facts are made by plain functions: an Arrow batch of 10,000 long texts filled a worker before."""
    docs = spark.createDataFrame([("s", 1, "One. Two!\n\nThree? " + "x" * 50), ("s", 2, None), ("s", 3, ""), ("s", 4, '[{"role": "user"}]')], "source string, doc_id long, text string")
    c = texts.chunks(docs, "source", "doc_id", "text", 20)
    found = texts.extract_facts(c, most=12)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "".join(r.chunk_text for r in c.filter("document_id = 1").orderBy("chunk_index").collect()) == "One. Two!\n\nThree? " + "x" * 50
    got = [(r.chunk_id, r.fact_index, r.fact) for r in found.orderBy("chunk_id", "fact_index").collect()]
    assert got[:3] == [("s_1_0", 0, "One."), ("s_1_0", 1, "Two!"), ("s_1_1", 0, "Three?")] and not any(i.startswith(("s_2", "s_3")) for i, _, _ in got)


def test_chunks_round_trip():
    long = "\n\n".join(" ".join(f"word{k}." for k in range(n)) for n in (50, 900, 3)) + "x" * 7000
    parts = texts.split_text(long, 1000)
    assert "".join(parts) == long and max(map(len, parts)) <= 1000
    turns = [{"role": "user", "text": "a" * 400} for _ in range(5)]
    parts = texts.split_turns(json.dumps(turns), 1000)
    assert [t for p in parts for t in json.loads(p)] == turns and len(parts) == 3
    assert texts.split_turns("[not json") is None


def test_clean_facts(spark):
    raw = spark.createDataFrame([(" Met ", "N/A", "Anna", "", "assistant", "event", None, None, datetime(2024, 1, 1)), ("", "none", None, None, "x", "state", None, None, None)], "what string, when string, who string, why string, fact_type string, kind string, occurred_start timestamp, occurred_end timestamp, reference timestamp")
    (got,) = texts.clean_facts(raw).collect()
    assert (got.text, got.fact_type, got.occurred_end) == ("Met | Involving: Anna", "experience", datetime(2024, 1, 1))


def test_budgets(spark):
    df = spark.createDataFrame([(1, k, n) for k, n in enumerate([5, 4, 3, 1])], "q long, id long, tokens long")
    assert [r.id for r in ranking.token_budget(df, ["q"], [F.col("id")], "tokens", 10).collect()] == [0, 1]
    # Rows beyond the budget in their own part still push what comes after them beyond it.
    parts = spark.createDataFrame([(1, 0, 4), (1, 1, 20), (1, 2, 3), (1, 3, 2)], "q long, id long, tokens long").repartition(4, "id")
    assert [(r.id, r.running_tokens) for r in ranking.token_budget(parts, ["q"], [F.col("id")], "tokens", 10).collect()] == [(0, 4)]
    t = spark.createDataFrame([(1, 0, "abcdef"), (1, 1, "ghij"), (1, 2, "k")], "q long, id long, t string")
    assert [r.t for r in ranking.text_budget(t, ["q"], [F.col("id")], "t", 8).orderBy("id").collect()] == ["abcdef", "gh"]
    e = spark.createDataFrame([(1, 0, "a", 0, 6), (1, 0, "a", 1, 6), (1, 1, "b", 0, 3), (1, 1, "b", 1, 2)], "query_id long, entity_no int, entity_id string, obs_no int, tokens int")
    assert sorted((r.entity_no, r.obs_no) for r in ranking.entity_budget(e, 10, 9).collect()) == [(0, 0), (1, 0)]


def test_duplicates_and_reasons(spark):
    df = spark.createDataFrame([(1, None, 0.5, None, None), (2, 1, 0.6, 0.5, 0.5), (3, 1, 0.5, 0.5, 0.5)], "new_id long, old_id long, new_score double, old_score double, old_strength double")
    assert [r.resolution for r in lifecycle.resolve_duplicates(df).orderBy("new_id").collect()] == ["KEEP", "REPLACE", "DROP"]


def test_context_capacity():
    c = sessions.Context()
    c.recall([(f"i{k}", 0.9 - 0.01 * k) for k in range(6)], 1)
    assert len(c.tiers["focus"]) == 5 and "i5" in c.tiers["supporting"]
    c.recall([("i5", 0.9)], 2)
    assert "i5" in c.tiers["focus"] and len(c.tiers["focus"]) == 5


def test_working_contexts_order_and_plan(spark):
    """Sessions in plain lists, as frames put them: by number, score (none last) and item (none last)."""
    rng = np.random.default_rng(11)
    rows = [(int(s), int(n) if n < 9 else None, f"i{i}" if i < 13 else None, float(x) if x < 0.95 else None) for s, n, i, x in zip(rng.integers(0, 5, 400), rng.integers(0, 10, 400), rng.integers(0, 14, 400), np.round(rng.uniform(0, 1, 400), 1), strict=True)]
    found = sessions.working_contexts(df := spark.createDataFrame(rows, "session_id long, recall_no int, item string, score double"))
    assert "FlatMapGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    want = []
    for s, pdf in df.toPandas().groupby("session_id"):
        c = sessions.Context()
        for n, part in pdf.sort_values(["recall_no", "score", "item"], ascending=[True, False, True]).groupby("recall_no", sort=True):
            c.recall(list(zip(part["item"].astype(str), part["score"], strict=True)), int(n))
        want += [(str(s), *r) for r in c.rows()]
    assert sorted(map(str, (tuple(r) for r in found.collect()))) == sorted(map(str, want))


def test_streams_equal_batch(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("s1", 1, "a", 0.9), ("s1", 1, "b", 0.5), ("s2", 1, "a", 0.2), ("s1", 2, "b", 0.8)]
    df = spark.createDataFrame(rows, "session_id string, recall_no int, item string, score double")
    df.write.parquet(str(tmp_path / "recalls"))
    stream = sessions.working_context_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "recalls")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("contexts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.session_id, r.tier, r.item, round(r.relevance, 6)) for r in sessions.working_contexts(df).collect()}
    assert {(r.session_id, r.tier, r.item, round(r.relevance, 6)) for r in spark.table("contexts").collect()} == want
    e = spark.createDataFrame([("s", k, at + timedelta(minutes=2 * k)) for k in range(6)], "s string, item long, ts timestamp")
    e.write.parquet(str(tmp_path / "events"))
    pairs = sessions.association_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "events")), "s", "item", "ts")
    q = pairs.writeStream.outputMode("append").format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(r.a, r.b) for r in sessions.associations(e, "s", "item", "ts").collect()}
    assert {(r.a, r.b) for r in spark.table("pairs").collect()} == want == {(a, b) for a in range(6) for b in range(a + 1, min(6, a + 3))}


def test_flush_and_tier_decay(spark, tmp_path):
    from mnemospark.sources.store import Store

    store = Store(spark, str(tmp_path / "store"))
    sessions.flush(spark.createDataFrame([("b", 1, 2), ("b", 1, 2), ("b", 2, 3)], "bank_id string, a long, b long"), store, 0)
    assert {(r.src, r.dst): r.weight for r in store.read("links").collect()} == {("1", "2"): 1.0, ("2", "3"): 0.5}
    more = spark.createDataFrame([("b", 7, 8)], "bank_id string, a long, b long")
    assert not sessions.flush(more, store, 0) and store.read("links").count() == 2  # a replayed batch
    assert sessions.flush(more, store, 1) and sessions.flush(more, store, 0, "other") and store.read("links").count() == 4
    df = spark.createDataFrame([("focus", 0.6, 1.0), ("focus", 0.2, 1.0), ("peripheral", 0.1, 1.0)], "tier string, relevance double, minutes double")
    assert sorted(r.tier for r in sessions.decayed(df, "precision").collect()) == ["focus", "peripheral"]


def test_a_walk_makes_the_links_of_its_frontier_only(spark):
    edges = spark.createDataFrame([("a", "b", "semantic", 0.8), ("a", "c", "semantic", 0.4), ("b", "d", "temporal", 1.0), ("x", "y", "semantic", 1.0), ("d", "x", "semantic", 1.0)], LINKS)
    seeds, met = spark.createDataFrame([(1, "a", 3.0), (2, "b", 1.0), (2, "q", 1.0)], "query_id long, node string, score double"), []

    def made(nodes):
        met.append(sorted(r.node for r in nodes.collect()))
        return edges.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi")

    of = lambda x: sorted(map(tuple, graph.pattern_search(seeds, seeds, x).collect()))
    assert of(made) == of(edges) and len(of(edges)) > 3
    assert met == [["a", "b", "q"], ["b", "c", "d"]]


def test_links_of_some_events(spark, sf):
    """They are what all links have of these events, and the tables' other rows do not move."""
    from mnemospark.plans.derived import event_links

    nodes = spark.range(0, 1000, 7).withColumnRenamed("id", "node").checkpoint()
    some, all_ = event_links(spark, sf, nodes), event_links(spark, sf)
    want = sorted(map(tuple, all_.join(nodes.withColumnRenamed("node", "src"), "src", "left_semi").select(*all_.columns).collect()))
    assert sorted(map(tuple, some.collect())) == want and {x[2] for x in want} == {"temporal", "semantic"}


def test_units_out_of_every_window_stay_where_they_are(spark, monkeypatch):
    """Few windows are sent to the units; many are not, and find the same."""
    at = datetime(2024, 1, 1)
    u = spark.createDataFrame([("bcd"[k % 3], k, at + timedelta(hours=k % 500)) for k in range(1500)], "bank string, id long, s timestamp").withColumns({"e": F.lit(None).cast("timestamp"), "m": F.lit(None).cast("timestamp")})
    q = spark.createDataFrame([("b", 1, at, at + timedelta(days=9)), ("c", 2, at + timedelta(days=3), at + timedelta(days=3, hours=1)), ("e", 3, at, at + timedelta(days=1))], "bank string, query_id long, low timestamp, high timestamp")
    few = retrieval.temporal_entries(u, q, 7, "id", "s", "e", "m", bank="bank")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert plan.count("LeftSemi, BuildRight") >= 2
    monkeypatch.setattr(ranking, "KEY_BYTES", 0)
    many = retrieval.temporal_entries(u, q, 7, "id", "s", "e", "m", bank="bank")
    assert "Broadcast" not in many._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and {r.query_id for r in few.collect()} == {1, 2}


def test_members_by_broadcast_and_by_shuffle(spark, monkeypatch):
    rows, keys = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "id long, t string"), spark.createDataFrame([(1,), (3,)], "id long").checkpoint()
    few = ranking.members(rows, keys, ["id"])
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(ranking, "KEY_BYTES", 0)
    assert sorted(map(tuple, ranking.members(rows, keys, ["id"]).collect())) == sorted(map(tuple, few.collect())) == [(1, "a"), (1, "b")]


def test_tokens_of_ascii_and_other_texts():
    for t in (None, "", "A_b-c9\x1cD\x7f", "É_x Kelvin ½ ٣", "\x00a\n\tb"):
        assert retrieval._tokens(t) == retrieval._TOKEN.findall((t or "").lower())
