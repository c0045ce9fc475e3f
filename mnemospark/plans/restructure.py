"""Hyper-schemas as queries: the vectors of a label are a bank's schemas, parts and events their properties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.operators import hyper
from mnemospark.sources.tables import table

#: The vectors of the tables are nearly uniform, so pairs are taken from this cosine on.
NEAR = 0.2


def _schemas(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A schema for each vector; its part's brand and size and its event's day are its properties."""
    e = table(spark, sf_dir, "embeddings")
    id_ = F.col("vec_id").cast("string")
    schemas = e.select(F.col("label").alias("of"), id_.alias("id"), F.col("embedding").alias("centroid"), (F.col("vec_id") % 7 + 1).alias("evidence"), id_.alias("description"))
    of = e.select("vec_id", F.col("label").alias("of"), id_.alias("id"))

    def named(rows: DataFrame, key: str, type_: str, **says: object) -> DataFrame:
        none = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in hyper.PROPERTY.split(", ")}
        return of.join(rows, "vec_id").select("of", "id", *(c.alias(n) for n, c in (none | {"key": F.lit(key), "type": F.lit(type_), "count": F.lit(1).cast("long")} | says).items()))

    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "vec_id")
    size = F.col("p_size").cast("double")
    event = table(spark, sf_dir, "events").select(F.col("event_id").alias("vec_id"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    brands = named(part, "brand", "categorical", value=F.col("p_brand"))
    sizes = named(part, "size", "numeric", mean=size, min=size, max=size)
    days = named(event, "day", "temporal", first_time=F.col("day"), last_time=F.col("day"))
    return schemas, brands.unionByName(sizes).unionByName(days)


_PAIRS = f"""
WITH v AS (SELECT label AS bank, vec_id, vec_id::VARCHAR AS id, embedding::DOUBLE[] AS e, p_brand AS brand, p_size::DOUBLE AS size, strftime(ts, '%Y-%m-%d') AS day
    FROM embeddings LEFT JOIN part ON p_partkey = vec_id LEFT JOIN events ON event_id = vec_id WHERE label IS NOT NULL),
s AS (SELECT x.bank, x.id AS a, y.id AS b, round(1 - list_cosine_similarity(x.e, y.e), 9) AS d,
    array_to_string(list_filter([CASE WHEN x.brand IS DISTINCT FROM y.brand THEN 'brand' END, CASE WHEN x.day IS DISTINCT FROM y.day THEN 'day' END, CASE WHEN x.size IS DISTINCT FROM y.size THEN 'size' END], lambda k: k IS NOT NULL), ', ') AS differing
    FROM v x JOIN v y ON x.bank = y.bank AND x.id < y.id),
m AS (SELECT *, row_number() OVER (PARTITION BY bank ORDER BY a, b) AS n FROM s WHERE d <= 1 - {NEAR} AND differing <> ''),
g AS (SELECT bank, list_reduce(list([a, b] ORDER BY n), lambda used, p: CASE WHEN list_has_any(used, p) THEN used ELSE list_concat(used, p) END) AS used FROM m GROUP BY bank),
taken AS (SELECT bank, used[2 * k - 1] AS a, used[2 * k] AS b FROM (SELECT bank, used, unnest(range(1, len(used) // 2 + 1)) AS k FROM g)),
pairs AS (SELECT m.* FROM m JOIN taken USING (bank, a, b))"""


def hyper_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parents of alike schemas that differ in a property, with what they are known by."""
    parents, _ = hyper.hyper_schemas(*_schemas(spark, sf_dir), NEAR)
    return parents.select(F.col("of").alias("bank"), "a", "b", F.round("similarity", 6).alias("similarity"), F.array_join("differing", ", ").alias("differing"), F.round(F.get("centroid", F.lit(0)), 6).alias("first"), F.round(F.get("centroid", F.lit(63)), 6).alias("last"), "evidence", "description")


HYPER_SCHEMAS = f"""{_PAIRS},
c AS (SELECT pairs.*, x.vec_id % 7 + y.vec_id % 7 + 2 AS evidence, list_transform(list_zip(x.e, y.e), lambda p: (p[1] + p[2]) / 2) AS c
    FROM pairs JOIN v x ON x.bank = pairs.bank AND x.id = a JOIN v y ON y.bank = pairs.bank AND y.id = b)
SELECT bank::VARCHAR AS bank, a, b, round(1 - d, 6) AS similarity, differing, round(c[1] / sqrt(list_sum(list_transform(c, lambda i: i * i))), 6) AS first,
    round(c[64] / sqrt(list_sum(list_transform(c, lambda i: i * i))), 6) AS last, evidence,
    '{hyper.DESCRIPTION.split("%s")[0].replace("'", "''")}' || a || '{hyper.DESCRIPTION.split("%s")[1].replace("'", "''")}' || b || '{hyper.DESCRIPTION.split("%s")[2].replace("'", "''")}' || differing || ')' AS description FROM c"""


def hyper_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of the parents: ranges joined, values that differ as a set."""
    parents, properties = hyper.hyper_schemas(*_schemas(spark, sf_dir), NEAR)
    named = properties.join(parents.select("of", "hyper_id", "a", "b"), ["of", "hyper_id"])
    return named.select(F.col("of").alias("bank"), "a", "b", "key", "type", F.coalesce("count", F.lit(0)).alias("count"), "mean", "min", "max", "first_time", "last_time", "value")


HYPER_PROPERTIES = f"""{_PAIRS},
t AS (SELECT pairs.bank::VARCHAR AS bank, a, b, x.brand AS xb, y.brand AS yb, x.size AS xs, y.size AS ys, x.day AS xd, y.day AS yd
    FROM pairs JOIN v x ON x.bank = pairs.bank AND x.id = a JOIN v y ON y.bank = pairs.bank AND y.id = b)
SELECT bank, a, b, 'brand' AS key, CASE WHEN xb <> yb THEN 'categorical_set' ELSE 'categorical' END AS type, CASE WHEN xb <> yb THEN 0 ELSE (xb IS NOT NULL)::BIGINT + (yb IS NOT NULL)::BIGINT END AS count, NULL::DOUBLE AS mean, NULL::DOUBLE AS min, NULL::DOUBLE AS max,
    NULL::VARCHAR AS first_time, NULL::VARCHAR AS last_time, CASE WHEN xb <> yb THEN least(xb, yb) || '|' || greatest(xb, yb) ELSE coalesce(xb, yb) END AS value FROM t WHERE coalesce(xb, yb) IS NOT NULL
UNION ALL SELECT bank, a, b, 'size', 'numeric', (xs IS NOT NULL)::BIGINT + (ys IS NOT NULL)::BIGINT, coalesce((xs + ys) / 2, xs, ys), least(xs, ys), greatest(xs, ys), NULL, NULL, NULL FROM t WHERE coalesce(xs, ys) IS NOT NULL
UNION ALL SELECT bank, a, b, 'day', 'temporal', (xd IS NOT NULL)::BIGINT + (yd IS NOT NULL)::BIGINT, NULL, NULL, NULL, least(xd, yd), greatest(xd, yd), NULL FROM t WHERE coalesce(xd, yd) IS NOT NULL"""


QUERIES = {"hyper_schemas": hyper_schemas, "hyper_properties": hyper_properties}
ORACLE_SQL = {"hyper_schemas": HYPER_SCHEMAS, "hyper_properties": HYPER_PROPERTIES}
