import math
from datetime import datetime
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import scoring, text, time, vector
from mnemospark.functions.constants import GATE_WEIGHTS, MODES, SCORE_WEIGHTS


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("a, s, r, want", [(5, 0, 0.5, 1), (0, 100, 0.5, 0), (5, -1, 0.5, 1), (5, 10, 0, 1), (-1, 10, 0.5, 0), (10, 10, 1, 1)])
def test_decay(spark, a, s, r, want):
    assert value(spark, scoring.decay(F.lit(a), F.lit(s), F.lit(float(r)))) == pytest.approx(want)


def test_decay_sides(spark):
    assert value(spark, scoring.decay(F.lit(5), F.lit(5), F.lit(0.5))) > 1 > value(spark, scoring.decay(F.lit(1), F.lit(100), F.lit(0.5)))


def test_weights_sum_to_one():
    assert all(abs(sum(SCORE_WEIGHTS[m]) - 1) < 1e-9 and abs(sum(GATE_WEIGHTS[m]) - 1) < 1e-9 for m in MODES)


def test_null_fallbacks(spark):
    none = F.lit(None).cast("double")
    assert value(spark, scoring.recency(none, F.lit(0.5))) == 0.5
    assert value(spark, scoring.thalamus_weight("precision", none, none, none, none)) == 0.5
    assert value(spark, scoring.thalamus_weight("exploration", none, F.lit(0.8), none, none)) == pytest.approx(0.2)
    assert value(spark, scoring.thalamus_weight("exploration", F.lit(0.9), none, none, none)) == 1.0
    assert value(spark, scoring.clamp(none)) is None
    assert value(spark, scoring.window_proximity(none, F.lit(0.0), F.lit(10.0))) == 0.5
    assert value(spark, scoring.novelty(none)) == 1.0 and value(spark, scoring.valence(none)) == 0.3


def test_bank_factor(spark):
    assert [round(value(spark, scoring.bank_factor(F.lit(n))), 6) for n in (0, 1, 50, 1000)] == [1.5, 1.5, 1.5, 1.0]


def test_strength_and_frequency(spark):
    assert value(spark, scoring.strength_weight(F.lit(1.0))) == 1.0
    assert value(spark, scoring.frequency(F.lit(9))) == 2.0 and value(spark, scoring.frequency(F.lit(0))) == 1.0
    assert value(spark, scoring.day_proximity(F.lit(0.0), F.lit(86399.0))) == 1.0
    assert value(spark, scoring.sigmoid(F.lit(0.0))) == 0.5


def test_disposition(spark):
    a = scoring.modulated_strength(F.lit(0.5), F.lit(-0.2), F.lit(False), F.lit(0.1), F.lit("analytical"))
    b = scoring.modulated_strength(F.lit(0.5), F.lit(0.1), F.lit(True), F.lit(0.9), F.lit("optimistic"))
    assert value(spark, a) == 0.5 and value(spark, b) == pytest.approx(0.78)


def test_vectors(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    assert value(spark, vector.cosine(a, z)) == 0 and value(spark, vector.cosine(a, z, 1.0)) == 1
    assert value(spark, vector.normalised(a)) == pytest.approx([0.6, 0.8])
    assert value(spark, vector.weighted_centroid(a, F.array(F.lit(4.0), F.lit(3.0)), F.lit(0.5), F.lit(0.5))) == pytest.approx([math.sqrt(0.5)] * 2)


def test_tags_and_tokens(spark):
    assert value(spark, text.tokens(F.lit("Für-die Café_1!"))) == ["für", "die", "café_1"]
    assert [value(spark, text.tag_key(F.lit(t))) for t in ("a:b", ":b", "a:", "ab", " x : y:z ")] == ["a", "_keywords", "_keywords", "_keywords", "x"]
    assert value(spark, text.tag_value(F.lit(" x : y:z "))) == "y:z" and value(spark, text.tag_value(F.lit(":b"))) == ":b"
    assert value(spark, text.query_tags(F.lit("The quick fox and der Hund"))) == ["fox", "hund", "quick"]
    assert value(spark, text.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>"))) == 0
    assert value(spark, text.strip_fence(F.lit("```json\n{\"a\": 1}\n```"))) == '{"a": 1}'


@pytest.mark.parametrize(
    "phrase, start, end",
    [("what was last saturday", "2024-05-11", "2024-05-11"), ("june 2023 please", "2023-06-01", "2023-06-30"), ("gestern war schön", "2024-05-14", "2024-05-14"), ("last weekend", "2024-05-11", "2024-05-12"), ("last month", "2024-04-01", "2024-04-30"), ("nothing", None, None)],
)
def test_date_phrases(spark, phrase, start, end):
    w = value(spark, time.phrase_window(F.lit(phrase), F.lit(datetime(2024, 5, 15, 12))))
    assert (None, None) == (start, end) if w is None else (str(w.start), str(w.end)) == (start, end)


def test_relative_dates(spark):
    at = F.lit(datetime(2024, 5, 15, 12))
    assert str(value(spark, time.relative_date(F.lit("we met 3 days ago"), at))) == "2024-05-12 00:00:00"
    assert value(spark, time.relative_date(F.lit("we met"), at)) is None


def test_name_ratio(spark):
    from mnemospark.operators.entities import name_ratio

    got = spark.createDataFrame([("Anna B", "anna berg")], "a string, b string").select(name_ratio("a", "b").alias("v")).first().v
    assert got == pytest.approx(SequenceMatcher(None, "anna b", "anna berg").ratio())
