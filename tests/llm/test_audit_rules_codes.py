import hashlib
import random
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import audit, common, rules, vector_codes
from mnemospark.llm.queries import QUERIES
from tests.llm.brute import words

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def plain_audit(docs, labels):
    """Every order walked document by document."""
    first, out = {}, {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in (0, 1))
    rows = []
    for d, t, s in docs:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > first[t]}
        rows.append((s or "", {f for f, x in fails.items() if x}, d in good, d in toxic))
    for part in {r[0] for r in rows}:
        own, removed = [r for r in rows if r[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(left), len(gone), sum(f in r[1] for r in own) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone), f]
        for (p, *_), r in out.items():
            if p == part:
                r[6] = removed[r[6]]
    return {k: tuple(r) for k, r in out.items()}


def table(spark, docs, labels):
    got = audit.audit(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}, len(got)


def audit_rows():
    rng = random.Random(5)
    docs = []
    for k in range(160):
        w = [f"{rng.choice(['w', 'W', 'É'])}{rng.randrange(rng.choice([9, 900]))}" for _ in range(rng.choice([3, 210, 400]))]
        docs.append((k, " ".join(w) + rng.choice(["", " #", " |", " ok"]), rng.choice(["a", "b", None, ""])))
    docs += [(300 + k, docs[k % 5][1], "a") for k in range(40)] + [(500, None, "b"), (501, "", "c"), (502, "", None), (None, "", "a"), (7, docs[7][1], docs[7][2]), (None, docs[7][1], "a"), (600, "Long " * 200_000, "d")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 400, 2)] + [(2, 1, 0), (2, 0, 0), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_audit_against_walking_every_order(spark):
    docs, labels = audit_rows()
    got, n = table(spark, docs, labels)
    assert got == plain_audit(docs, labels) and n == 600 * 5 and any(r[0] for r in got.values())


def test_audit_of_hot_texts_without_broadcast(spark, monkeypatch):
    """Beyond what may be broadcast the joins shuffle, with the same rows."""
    docs, labels = audit_rows()
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    assert table(spark, docs, labels)[0] == plain_audit(docs, labels)


def test_audit_odd_tables(spark):
    docs, labels = spark.createDataFrame([(1, "x", "a")], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(docs.limit(0), labels).count() == 0
    wide = docs.withColumns({"part": F.lit("q"), "mask": F.lit(3), "words": F.lit("z"), "before": F.lit(1), "first": F.lit(0), "rows": F.lit(2)})
    assert sorted(audit.audit(wide, labels.withColumn("marked", F.lit(1))).collect()) == sorted(audit.audit(docs, labels).collect())
    assert audit.edges(spark.createDataFrame([("a", 1, 2, 1, 0)], "part string, mask int, n long, good long, toxic long"), 2).count() == 4
    assert audit.steps(spark).count() == 600


def plain_codes(rows, parts=8, entries=16, rounds=6):
    rows = [r for r in rows if r[1] is not None and all(e is not None and np.isfinite(e) for e in r[1])]
    x = np.array([[int(np.floor(4096 * e)) for e in r[1]] for r in rows], np.int64).reshape(len(rows), parts, -1)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, x[i].ravel().tolist()))
    book = x[order[:entries]].swapaxes(0, 1).copy()

    def nearest():
        return np.stack([((x[:, p, None, :] - book[p][None]) ** 2).sum(2).argmin(1) for p in range(parts)], 1)

    for _ in range(rounds):
        codes = nearest()
        for p in range(parts):
            for e in range(book.shape[1]):
                own = x[codes[:, p] == e, p]
                if len(own):
                    book[p, e] = [int(s) // len(own) for s in own.sum(0)]
    codes = nearest()
    error = sum(((x[:, p] - book[p][codes[:, p]]) ** 2).sum(1) for p in range(parts)).tolist()
    by_label = {}
    for r, e in zip(rows, error, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return sorted(str((r[0], "".join(f"{c:02x}" for c in row), e, by_label[r[2]], digest)) for r, row, e in zip(rows, codes.tolist(), error, strict=True))


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors(n, seed=1, dims=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    x = np.round((centres[rng.integers(0, 20, n)] + 0.1 * rng.normal(size=(n, dims))) * 8).astype(np.float32) / 8  # many ties
    return [(int(k), [float(e) for e in v], int(rng.integers(0, 4)) if k % 7 else None) for k, v in enumerate(x)]


@pytest.mark.parametrize("block", [16, 1024])
def test_codes_against_full_scans(spark, monkeypatch, block):
    rows = vectors(700)
    hot = rows[3]
    rows += [(1000 + k, hot[1], hot[2]) for k in range(300)] + [(5, rows[6][1], 1), (None, rows[8][1], None), (2000, None, 1), (2001, [0.0] * 15 + [float("nan")], 1), (2002, [float("inf")] + [0.0] * 15, None), (2003, [None] + [0.0] * 15, 2)]
    random.Random(2).shuffle(rows)
    monkeypatch.setattr(vector_codes, "BLOCK", block)
    got = vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(str((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256)) for r in got) == plain_codes(rows)


def test_bounds_spare_scans(spark):
    """Well-parted vectors are looked at again in few of the rounds' chances, and codes stay exact."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(16, 16)) * 20
    rows = [(k, [float(np.float32(e)) for e in centres[k % 16] + 0.3 * rng.normal(size=16)], 0) for k in range(2000)]
    df = spark.createDataFrame(rows, VECTORS)
    _, _, _, scanned = vector_codes.fit(vector_codes.kept(df))
    assert scanned[0] == 16_000 and scanned[-1] < 1600
    assert sorted(str(tuple(r)) for r in vector_codes.compress(df).collect()) == plain_codes(rows)


def test_codes_without_broadcast(spark, monkeypatch):
    rows = vectors(120)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 100)
    assert sorted(str(tuple(r)) for r in vector_codes.compress(spark.createDataFrame(rows, VECTORS)).collect()) == plain_codes(rows)


def test_codes_of_odd_tables(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vector_codes.compress(empty).count() == 0 and vector_codes.compress(spark.createDataFrame([(1, None, 1)], VECTORS)).count() == 0
    few = vectors(5)
    wide = spark.createDataFrame(few, VECTORS).withColumns({"x": F.lit(1), "code": F.lit("a"), "ids": F.lit(2)})
    assert sorted(str(tuple(r)) for r in vector_codes.compress(wide).collect()) == plain_codes(few)
    mixed = few + [(1, [], 1), (9, [1.0, 2.0], 1)]
    got = {(r.vec_id, r.code is None): r for r in vector_codes.compress(spark.createDataFrame(mixed, VECTORS)).collect()}
    assert len(got) == 7 and got[1, True].error is None and got[9, True].code is None and got[1, False].code
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1)], VECTORS))
    with pytest.raises(Exception, match="beyond"):
        vector_codes.compress(spark.createDataFrame([(k, [0.0] * 15 + [1e30 * (k == 20)], 1) for k in range(21)], VECTORS)).collect()


def corpus(n, seed=4):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        w = [rng.choice(["of", "to", "a"]) if rng.random() < 0.3 else f"word{rng.randrange(500)}" for _ in range(rng.randrange(30, 150))]
        bad = rng.random() < 0.25
        text = " ".join(x + "##" for x in w) if bad and k % 2 else " ".join(w[:3] * (len(w) // 3)) if bad else " ".join(w)
        out.append((k, text, int(not bad)))
    return out


@pytest.fixture(scope="module")
def learned(spark):
    rows = corpus(700)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    return rows, docs, labels, rules.fit(docs, labels)


def test_rules_on_held_out_rows(learned):
    rows, docs, labels, ensemble = learned
    got = {r.doc_id: r for r in rules.score(docs, labels, ensemble=ensemble).collect()}
    held = [(d, q) for d, _, q in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r.held_out} == {d for d, _ in held}
    assert np.mean([got[d].predicted == q for d, q in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert 0 < len(ensemble.rules) < 100 and len(ensemble.describe()) == len(ensemble.rules)


def test_labels_of_held_out_rows_teach_nothing(learned):
    rows, docs, labels, ensemble = learned
    other = labels.withColumn("quality", F.when(rules.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rules.fit(docs, other).describe() == ensemble.describe()


def test_compiled_rules_against_plain_code(learned):
    """Statistics and rules, by loops over texts."""
    rows, docs, labels, ensemble = learned
    odd = [(9000, None), (9001, ""), (9002, "ÀB c, D!! 12\n\nÀB c, D!! 12\n |"), (9003, "Word ! " * 50_000)]
    both = docs.limit(40).collect() + odd
    table = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in both], "doc_id long, text string")
    got = {r.doc_id: r.score for r in rules.score(table, labels, ensemble=ensemble).collect()}
    has = {r.doc_id: r.stats for r in rules.statistics(table.select("doc_id", common.text_of(table).alias("text"))).collect()}
    for d, text in ((r[0], r[1] or "") for r in both):
        w, lines = words(text), text.split("\n")
        n, letters = max(1, len(w)), sum(map(len, w))
        count = lambda cs: sum(c in cs for c in text)  # noqa: E731, B023
        want = [len(w), letters / n, len(set(w)) / n**0.5, sum(len(x) <= 3 for x in w) / n, 1 - len(set(lines)) / len(lines), len(w) / len(lines), sum("A" <= c <= "Z" for c in text) / max(1, letters), count("#$%&*|<>~") / n, count("0123456789") / n, count(".,;:?") / n, count("!") / n]
        assert has[d] == pytest.approx(want)
        z = ensemble.bias + sum(v for rule, v in ensemble.rules if all(want[k] <= at if op == "<=" else want[k] > at for k, op, at in rule))
        assert got[d] == pytest.approx(1 / (1 + np.exp(-z)))


def test_paths_of_a_tree():
    tree = "DecisionTreeClassificationModel: uid=x, depth=2\n  If (feature 0 <= 1.5)\n   If (feature 0 <= 0.5)\n    Predict: 0.0\n   Else (feature 0 > 0.5)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    assert rules.paths(tree) == [((0, "<=", 1.5),), ((0, "<=", 0.5),), ((0, "<=", 1.5), (0, ">", 0.5)), ((0, ">", 1.5),)]


def test_rules_of_odd_tables(spark, learned):
    _, docs, labels, _ = learned
    none = spark.createDataFrame([], "doc_id long, quality int")
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "")], "doc_id long, text string")
    assert [r.score for r in rules.score(odd, none).collect()] == [0.0] * 4
    assert [r.score for r in rules.score(odd, spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")).collect()] == [1.0] * 4
    same = spark.createDataFrame([(k, "same text") for k in range(40)], "doc_id long, text string")
    half = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    assert len({r.score for r in rules.score(same, half).collect()}) == 1
    assert rules.score(docs.limit(0), labels).count() == 0
    wide = docs.withColumns({"stats": F.lit("a"), "n": F.lit(1), "lines": F.lit(2), "row": F.lit(3), "label": F.lit(4)})
    kept = rules.keep_good(wide, labels)
    assert kept.columns == wide.columns and 0 < kept.count() < docs.count()


def test_rules_on_the_test_tables(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op12_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95
