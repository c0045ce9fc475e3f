import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mnemospark.llm import toxicity
from mnemospark.llm.queries import QUERIES
from mnemospark.llm.sql import ORACLE_SQL

DOCS = "doc_id long, text string"
BAD = ["scoundrel", "rotter", "blighter"]


def corpus(n, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(400)]
    out = []
    for k in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(20, 120))]
        bad = rng.random() < 0.2
        for _ in range(rng.randrange(3, 7) if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(BAD).capitalize() + rng.choice(["", ",", "!"]))
        out.append((k, " ".join(w), int(bad)))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(900)
    docs = spark.createDataFrame([r[:2] for r in rows], DOCS)
    labels = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, toxic int")
    return rows, docs, labels, {r.doc_id: r for r in toxicity.score(docs, labels).collect()}


def test_held_out_accuracy(scored):
    rows, _, _, got = scored
    held = [(d, t) for d, _, t in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r.held_out} == {d for d, _ in held}
    assert np.mean([got[d].predicted == t for d, t in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_labels_of_held_out_rows_are_not_used(spark, scored):
    rows, docs, labels, got = scored
    other = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score(docs, other).collect()}
    assert again == pytest.approx({d: r.score for d, r in got.items()})


def test_model_against_plain_counts(scored):
    """The word part of the models, from counts made plainly."""
    rows, docs, labels, _ = scored
    learn = [(t, y) for d, t, y in rows if zlib.crc32(str(d).encode()) % 5 > 1]
    before = {0: {}, 1: {}}
    for t, y in learn:
        w = t.lower().replace(",", " ").replace("!", " ").split()
        for a, b in zip(["", *w], w, strict=False):
            before[y].setdefault(b, set()).add(a)
    words = set(before[0]) | set(before[1])
    n = {y: {w: len(before[y].get(w, ())) for w in words} for y in before}
    both = {w: len(before[0].get(w, set()) | before[1].get(w, set())) for w in words}
    total, all_ = {y: sum(n[y].values()) for y in n}, sum(both.values())
    rest = {y: 1 - sum(max(c - 3, 0) for c in n[y].values()) / total[y] for y in n}
    want = {w: np.log((max(n[1][w] - 3, 0) / total[1] + rest[1] * both[w] / all_) / (max(n[0][w] - 3, 0) / total[0] + rest[0] * both[w] / all_)) for w in words}
    m = toxicity.fit(docs, labels).models.value
    have = dict(zip(m.words.tolist(), m.word.tolist(), strict=True))
    for w in words:
        (h,) = toxicity.word_hashes(w)
        assert have.get(int(h), m.unseen) == pytest.approx(want[w], abs=1e-4)


def test_a_joined_model_gives_the_same_scores(spark, scored, monkeypatch):
    """Where only some or no words may be broadcast, and where documents share an id."""
    rows, docs, labels, got = scored
    for most in (0, 150):
        monkeypatch.setattr(toxicity, "HOT_WORDS", most)
        again = {r.doc_id: r.score for r in toxicity.score(docs, labels).collect()}
        assert again == pytest.approx({d: r.score for d, r in got.items()}, abs=1e-6)
    twins = docs.unionByName(spark.createDataFrame([(0, "Rotter! rotter, scoundrel blighter rotter"), (0, "v1 v2 v3"), (None, "v1")], DOCS))
    kept = {(r.doc_id, r.text) for r in toxicity.keep_ordinary(twins, labels).collect()}
    assert (0, "v1 v2 v3") in kept and (None, "v1") in kept and not any("Rotter!" in t for d, t in kept if d == 0)


def test_scores_against_plain_code(scored):
    """The whole way from counts to scores, by loops over words."""
    rows, docs, labels, got = scored
    s = toxicity.fit(docs, labels)
    d = dict(zip(s.models.value.words.tolist(), s.models.value.word.tolist(), strict=True))
    mean, scale, w = s.fitted
    for k, t, _ in rows[:60]:
        hashes = [int(toxicity.word_hashes(x)[0]) for x in t.lower().replace(",", " ").replace("!", " ").split()]
        says = [d.get(h, s.models.value.unseen) for h in hashes]
        seen = [d[h] for h in hashes if h in d]
        lean = [x for x in says if x > toxicity.LEANS]
        f = [(sum(seen) + 20 * s.models.value.usual) / (len(seen) + 20), sum(lean) / len(hashes) ** 0.5, np.log1p(sum(lean)), len(lean) / len(hashes) ** 0.5]
        z = w[0] + sum(b * (x - m) / c for b, x, m, c in zip(w[1:], f, mean, scale, strict=True))
        assert got[k].score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-5)


def test_ties_of_labels_count_as_toxic(spark, scored):
    rows, docs, labels, got = scored
    tied = labels.unionByName(labels.filter("toxic = 1").withColumn("toxic", F.lit(0)))
    assert {r.doc_id: r.score for r in toxicity.score(docs, tied).collect()} == pytest.approx({d: r.score for d, r in got.items()})


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, ""), (3, "w " * 100_000)], DOCS)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r.score for r in toxicity.score(docs, none).collect()] == [0.0] * 5
    one = spark.createDataFrame([(1, 1), (None, 1), (2, None), (1, 0)], "doc_id long, toxic int")
    assert len(toxicity.score(docs, one).collect()) == 5 and toxicity.score(docs.limit(0), one).count() == 0
    few = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, toxic int")
    assert len(toxicity.score(docs, few).collect()) == 5
    wide = docs.withColumn("label", F.lit("x")).withColumn("fold", F.lit(1)).withColumn("marked", F.lit(2))
    assert toxicity.keep_ordinary(wide, few).columns == wide.columns


def test_pipeline_stages(spark, tmp_path):
    """Planted cases go, clean documents stay, and the last stage packs what is left."""
    rng = random.Random(9)
    rows = corpus(300, seed=8)
    item = " ".join(f"i{k}" for k in range(25))
    copy = " ".join(f"c{rng.randrange(500)}" for _ in range(90))
    docs = [(d, t + f"\nLine number {d}") for d, t, _ in rows]
    docs += [(1000, "start " + item + " end"), (1001, copy), (1002, copy + " more"), (1003, copy.replace("c1", "c2", 1))]
    docs = [(d, "Shared Footer\n" + t) for d, t in docs]
    for name, df in {
        "documents": spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame([(d, 1, t) for d, _, t in rows], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([(0, item)], "item_id long, text string"),
    }.items():
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    left = set(out["doc_id"])
    toxic = {d for d, _, t in rows if t}
    clean = {d for d, _, t in rows if not t}
    assert len(left & clean) > 0.97 * len(clean) and len(left & toxic) < 0.1 * len(toxic)
    assert left & {1000, 1001, 1002, 1003} == {1001}
    stage = dict(corpus_pipeline.STAGES)["line_dedup"]
    texts = [r.text for r in stage(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)).collect()]
    assert not any("Shared Footer" in t for t in texts) and any("Line number" in t for t in texts)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontaminate", "best_fit_packing"]


def test_large_groups_of_copies_keep_one(spark, tmp_path):
    """Of ten copies or more, exact or near ones, line dedup empties none and near dedup keeps one whole."""
    rng = random.Random(3)
    say = lambda n: " ".join(f"z{rng.randrange(3000)}" for _ in range(n))
    exact, near = "\n".join(say(30) for _ in range(4)), [say(30) for _ in range(9)]
    docs = [(k, exact) for k in range(25)] + [(100 + k, "\n".join([*near, f"copy {k}"])) for k in range(15)]
    docs += [(200 + k, "Shared Footer\n" + say(40)) for k in range(12)]
    passage = say(60)  # more than half of its documents, but no copy
    docs += [(300 + k, f"{say(9)}\n{passage}\nShared Footer") for k in range(12)]
    stage, df = dict(corpus_pipeline.STAGES), spark.createDataFrame(docs, DOCS)
    lines = stage["line_dedup"](spark, df, str(tmp_path))
    assert not any(r.text == "" or "Shared Footer" in r.text or (r.doc_id >= 300 and passage in r.text) for r in lines.collect())
    left = {r.doc_id: r.text for r in stage["near_dedup"](spark, lines, str(tmp_path)).collect()}
    assert [t for d, t in left.items() if d < 100] == [exact]
    # Lines that texts share without being copies go, although they are most of each text.
    common = [say(10) for _ in range(6)]
    mixed = [(400 + k, "\n".join([*common, *(say(6) for _ in range(4))])) for k in range(30)] + [(500, None), (501, "")]
    shared = stage["line_dedup"](spark, spark.createDataFrame(mixed, DOCS), str(tmp_path)).collect()
    assert len(shared) == 32 and not any(x in (r.text or "") for r in shared for x in common) and all((r.text or "").count("\n") == 3 for r in shared if r.doc_id < 500)
    assert [t.split("\n")[:9] for d, t in left.items() if 100 <= d < 200] == [near] and len(left) == 26


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    got, want = QUERIES[name](spark, sf).toPandas(), c.sql(ORACLE_SQL[name]).df()
    key = lambda df: sorted(map(str, df[sorted(df.columns)].itertuples(index=False, name=None)))
    assert key(got) == key(want)
