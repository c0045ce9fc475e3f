from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from mnemospark.plans.facade import Memory
from mnemospark.sources.store import Store

NOW = datetime(2024, 5, 10, tzinfo=timezone.utc)
ITEMS = [
    ("b1", "d1", "Anna met Peter in Berlin. They spoke about the harbour project.", NOW, ["fact"]),
    ("b1", "d2", "Peter likes coffee in the morning. Anna prefers green tea.", datetime(2024, 5, 9, tzinfo=timezone.utc), ["experience"]),
    ("b2", "d1", "The server in Oslo failed at night.", NOW, None),
]


@pytest.fixture(scope="module")
def memory(spark, tmp_path_factory):
    m = Memory(Store(spark, str(tmp_path_factory.mktemp("store"))))
    m.store.append({"banks": spark.createDataFrame([("b1", 3), ("b2", 1)], "bank_id string, session_count long")})
    items = spark.createDataFrame(ITEMS, "bank_id string, document_id string, content string, event_date timestamp, tags array<string>")
    m.retain(items, now=NOW)
    return m


def test_retain_is_repeatable(memory, spark):
    assert memory.store.read("units").count() == 5
    assert memory.store.read("dictionary").count() == 5
    memory.retain(spark.createDataFrame(ITEMS[:1], "bank_id string, document_id string, content string, event_date timestamp, tags array<string>"), now=NOW)
    assert memory.store.read("units").count() == 5
    assert memory.store.read("documents").count() == 3


def test_recall_stays_in_the_bank(memory, spark):
    asked = spark.createDataFrame([(1, "b1", "what does Peter like in the morning"), (2, "b2", "which server failed"), (3, "b1", "")], "query_id long, bank_id string, query string")
    found = memory.recall(asked, "exploration", now=NOW).collect()
    first = {r.query_id: r.text for r in found if r.rank == 1}
    assert "coffee" in first[1] and "Oslo" in first[2]
    assert all("Oslo" not in r.text for r in found if r.query_id == 1)


def test_links_and_entities(memory):
    kinds = {r.type for r in memory.store.read("links").select("type").distinct().collect()}
    assert {"temporal", "entity"} <= kinds
    assert {r.canonical_name for r in memory.list_entities("b1").collect()} >= {"Anna", "Peter", "Berlin"}
    nodes, edges = memory.graph("b1")
    assert nodes.count() == 4 and edges.count() > 0


def test_lists_and_stats(memory):
    assert memory.list_units("b1", needle="COFFEE").count() == 1
    assert {r.document_id: r.units for r in memory.list_documents("b1").collect()} == {"d1": 2, "d2": 2}
    assert {r.bank_id: r.units for r in memory.stats().collect()} == {"b1": 4, "b2": 1}


def test_consolidate_and_versions(memory, spark, tmp_path):
    before = memory.store.versions()[-1]
    report = memory.consolidate(("promote", "decay", "cluster", "nothing"), now=NOW)
    assert str(report["nothing"]).startswith("failed") and isinstance(report["cluster"], int)
    assert memory.store.read("banks").filter("bank_id = 'b1'").first().session_count == 4
    assert memory.store.read("banks", version=before).filter("bank_id = 'b1'").first().session_count == 3
    counts = memory.store.backup(str(tmp_path / "copy"))
    other = Store(spark, str(tmp_path / "other"))
    other.restore(str(tmp_path / "copy"))
    assert other.read("units").count() == counts["units"] == 5


def test_records(memory, spark):
    memory.put("operations", spark.createDataFrame([("o1", "b1", "retain", "open"), ("o2", "b1", "retain", "done")], "operation_id string, bank_id string, type string, status string"))
    memory.put("operations", spark.createDataFrame([("o1", "b1", "retain", "failed")], "operation_id string, bank_id string, type string, status string"))
    assert [(r.operation_id, r.status) for r in memory.operations("b1").collect()] == [("o1", "failed"), ("o2", "done")]
    memory.cancel("b1", "o1")
    assert memory.operations("b1", "failed").count() == 0
    memory.record("retain", spark.createDataFrame([("b1", 3)], "bank_id string, facts int"))
    assert memory.traces("b1", "retain").first().body == '{"facts":3}'
    anna = memory.get("entities", bank_id="b1", name_key="anna").first()
    assert anna.mention_count == 2 and memory.entity("b1", anna.entity_id).count() == 2
    assert {(r.bank_id, r.n) for r in memory.layers().groupBy("bank_id").agg(F.sum("n").alias("n")).collect()} == {("b1", 4), ("b2", 1)}


def test_delete_takes_dependents_along(memory):
    gone = memory.store.delete(bank="b1", document="d2")
    assert gone["units"] == 2 and gone["documents"] == 1
    left = {r.unit_id for r in memory.store.read("units").collect()}
    ends = memory.store.read("links").select(F.explode(F.array("src", "dst")).alias("x")).distinct().collect()
    assert {r.x for r in ends} <= left


def test_a_crowded_bank_takes_nothing_from_others(spark, tmp_path):
    """A query of a small bank finds its fact beside a hundred better ones of another bank, in every channel."""
    m = Memory(Store(spark, str(tmp_path / "s")))
    schema = "bank_id string, document_id string, content string, event_date timestamp, tags array<string>"
    crowd = [("b1", f"d{k}", f"The server in Oslo failed at night number {k}.", NOW, ["fact"]) for k in range(120)]
    m.retain(spark.createDataFrame([*crowd, ("b2", "d", "The server in Oslo failed at night.", NOW, ["fact"])], schema), now=NOW)
    asked = spark.createDataFrame([(1, "b2", "which server in Oslo failed at night"), (2, "b3", "server")], "query_id long, bank_id string, query string")
    found = m.recall(asked, budget=5, now=NOW).collect()
    assert [(r.query_id, r.rank) for r in found] == [(1, 1)] and found[0].text.startswith("The server in Oslo")
    again = spark.createDataFrame([("b2", "e", "The server in Oslo failed at night. ", NOW, ["fact"])], schema)
    m.retain(again, now=NOW)
    row = m.store.read("dictionary").filter("bank_id = 'b2'").orderBy("novelty").first()
    assert row.novelty < 0.2  # its twin is found although 120 others lie as near


def test_three_cycles_make_one_schema(spark, tmp_path):
    """A cluster is a fingerprint, then a schema, and then takes each later member as evidence once; banks keep apart."""
    m = Memory(Store(spark, str(tmp_path)))
    near = lambda k, x: [1.0, 0.01 * k, x]

    def add(bank, ks, x=0.0):
        units = [(f"u{k}", bank, near(k, x)) for k in ks]
        m.store.append({
            "units": spark.createDataFrame(units, "unit_id string, bank_id string, embedding array<float>"),
            "dictionary": spark.createDataFrame([(u, b, "buffer", "active") for u, b, _ in units], "engram_id string, bank_id string, layer string, status string"),
        })

    add("b", range(5))
    add("c", range(3), 3.0)
    add("d", range(2))
    schemas = lambda: {r.bank_id: (r.schema_id, r.evidence) for r in m.store.read("schemas").collect()}
    report = [m.consolidate(("cluster",), now=NOW)]
    assert schemas() == {} and {(r.bank_id, r.cycles) for r in m.store.read("fingerprints").collect()} == {("b", 1), ("c", 1)}
    report.append(m.consolidate(("cluster",), now=NOW))
    first = schemas()
    assert {b: n for b, (_, n) in first.items()} == {"b": 5, "c": 3}
    add("b", range(5, 7))
    report += [m.consolidate(("cluster",), now=NOW) for _ in range(2)]
    assert all(isinstance(r["cluster"], int) for r in report), report
    assert schemas() == {"b": (first["b"][0], 7), "c": first["c"]}
    assert m.store.read("links").filter("type = 'schema'").groupBy("bank_id").count().rdd.collectAsMap() == {"b": 7, "c": 3}
    assert {(r.bank_id, r.cycles) for r in m.store.read("fingerprints").collect()} == {("b", 4), ("c", 4)}


def test_no_write_is_lost(spark, tmp_path):
    from mnemospark.sources.store import Conflict

    store, other = Store(spark, str(tmp_path)), Store(spark, str(tmp_path))
    banks = lambda *names: spark.createDataFrame([(n, 0) for n in names], "bank_id string, session_count long")
    names = lambda: {r.bank_id for r in store.read("banks").collect()}
    a, b = store._put("banks", banks("a")), other._put("banks", banks("b"))  # two appends, interleaved
    assert (other.commit({}, {"banks": b}), store.commit({}, {"banks": a})) == (1, 2)
    assert names() == {"a", "b"}
    base, path = store.version(), store._put("banks", banks("c"))
    other.append({"banks": banks("d")})
    with pytest.raises(Conflict):
        store.commit({"banks": [path]}, base=base)
    assert not store._publish(store.version(), "{}")  # a version is never replaced
    assert store.commit({"units": []}, base=base) == 4  # other tables do not conflict
    assert names() == {"a", "b", "d"}
    assert store.compact(2) == 5 and len(store.manifest()["banks"]) == 1
    assert names() == {"a", "b", "d"} and store.compact(2) is None


def test_schemas_are_updated_and_archived(spark, tmp_path):
    m = Memory(Store(spark, str(tmp_path)))
    rows = [("b", "s1", 3, "active"), ("b", "s2", 4, "active"), ("c", "s1", 5, "active")]
    m.put("schemas", spark.createDataFrame(rows, "bank_id string, schema_id string, evidence long, status string"))
    m.update_schema("b", "s1", evidence=9)
    m.archive_schema("b", "s2")
    got = {(r.bank_id, r.schema_id): (r.evidence, r.status) for r in m.store.read("schemas").collect()}
    assert got == {("b", "s1"): (9, "active"), ("b", "s2"): (4, "archived"), ("c", "s1"): (5, "active")}
    assert [r.schema_id for r in m.list_schemas("b").collect()] == ["s1"]
    for fields in ({"schema_id": "x"}, {"bank_id": "x"}, {"colour": 1}):
        with pytest.raises(ValueError):
            m.update_schema("b", "s1", **fields)


def test_protected_tables_need_a_schema():
    from mnemospark.sources.tables import check_qualified

    for sql in ("SELECT * FROM memory.units u JOIN `memory`.`links` USING (a)", "SELECT units FROM other", "INSERT INTO a.b.units VALUES (1)"):
        check_qualified(sql, ["units", "links"])
    for sql in ("select 1 from Units", "SELECT * FROM memory.units JOIN links l", "UPDATE `units` SET a = 1", "DELETE FROM links;"):
        with pytest.raises(ValueError):
            check_qualified(sql, ["units", "links"])


def test_alike_schemas_get_a_parent_once(spark, tmp_path):
    m = Memory(Store(spark, str(tmp_path)))
    rows = [("s1", "b", [1.0, 0.0], {"place": "Berlin", "who": "Anna"}, 3, "active"), ("s2", "b", [0.9, 0.1], {"place": "Oslo", "who": "Anna"}, 2, "active"), ("s3", "b", [0.9, 0.1], {"place": "Rome"}, 2, "archived"), ("s4", "c", [1.0, 0.0], {"place": "Rome"}, 1, "active")]
    m.store.append({"schemas": spark.createDataFrame(rows, "schema_id string, bank_id string, centroid array<double>, properties map<string,string>, evidence long, status string")})
    assert isinstance(m.consolidate(("restructure",), now=NOW)["restructure"], int)
    (parent,) = m.store.read("schemas").filter("schema_id like 'hyper-%'").collect()
    assert (parent.bank_id, parent.evidence, parent.properties) == ("b", 5, {"place": "Berlin|Oslo", "who": "Anna"})
    assert {(r.src, r.dst, r.type) for r in m.store.read("schema_edges").collect()} == {(s, parent.schema_id, "specializes") for s in ("s1", "s2")}
    assert isinstance(m.consolidate(("restructure",), now=NOW)["restructure"], int)
    assert m.store.read("schemas").count() == 5 and m.store.read("schema_edges").count() == 2
