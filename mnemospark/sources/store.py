"""Versioned Parquet tables: appends, upserts, cascading deletes, backup and restore.

A version is an immutable folder with one folder per table and a manifest
written last, so a reader sees a whole version or none and a job that fails
half-way leaves the one before. All paths go through Spark's own file system.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.session import ship

_L, _S, _D, _TS, _I = T.LongType(), T.StringType(), T.DoubleType(), T.TimestampType(), T.IntegerType()


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: The tables and their columns.
SCHEMAS = {
    "banks": _schema(bank_id=_S, background=_S, tier=_S, op_count=_L, session_count=_L, skepticism=_I, literalism=_I, empathy=_I),
    "documents": _schema(document_id=_S, bank_id=_S, original_text=_S, content_hash=_S, metadata=T.MapType(_S, _S)),
    "chunks": _schema(chunk_id=_S, document_id=_S, bank_id=_S, chunk_index=_I, chunk_text=_S),
    "units": _schema(unit_id=_S, bank_id=_S, document_id=_S, chunk_id=_S, text=_S, embedding=T.ArrayType(T.FloatType()), fact_type=_S, event_date=_TS, occurred_start=_TS, occurred_end=_TS, mentioned_at=_TS),
    "entities": _schema(entity_id=_S, bank_id=_S, canonical_name=_S, name_key=_S, mention_count=_L, last_seen=_TS),
    "unit_entities": _schema(unit_id=_S, entity_id=_S, bank_id=_S),
    "links": _schema(src=_S, dst=_S, type=_S, weight=_D, entity=_S, bank_id=_S),
    "dictionary": _schema(engram_id=_S, bank_id=_S, strength=_D, layer=_S, status=_S, tags=T.ArrayType(_S), novelty=_D, surprise=_D, task_relevance=_D, emotional_valence=_D, overall=_D, access_count=_L, created_session=_L),
    "schemas": _schema(schema_id=_S, bank_id=_S, centroid=T.ArrayType(_D), properties=T.MapType(_S, _S), evidence=_L, status=_S, last_reinforced=_TS),
    "schema_edges": _schema(src=_S, dst=_S, type=_S, bank_id=_S),
    "fingerprints": _schema(id=_S, bank_id=_S, centroid=T.ArrayType(_D), cycles=_I, last_seen=_TS),
    "access_events": _schema(unit_id=_S, bank_id=_S, at=_TS),
    "drift_events": _schema(bank_id=_S, schema_id=_S, alpha=_D, query_hash=_S, mode=_S),
    "operations": _schema(operation_id=_S, bank_id=_S, type=_S, status=_S, error=_S),
    "traces": _schema(trace_id=_S, bank_id=_S, kind=_S, at=_TS, body=_S),
    "working_memory": _schema(bank_id=_S, version=_I, body=_S),
    "model_config": _schema(bank_id=_S, body=_S),
}
#: Key columns that an upsert replaces by, and what a delete of a unit, document or bank takes along.
KEYS = {
    "banks": ["bank_id"],
    "documents": ["document_id", "bank_id"],
    "chunks": ["chunk_id"],
    "units": ["unit_id"],
    "entities": ["bank_id", "name_key"],
    "unit_entities": ["unit_id", "entity_id"],
    "links": ["src", "dst", "type", "entity"],
    "dictionary": ["engram_id"],
    "schemas": ["bank_id", "schema_id"],
    "schema_edges": ["src", "dst", "type"],
    "fingerprints": ["bank_id", "id"],
    "operations": ["operation_id"],
    "traces": ["trace_id"],
    "working_memory": ["bank_id"],
    "model_config": ["bank_id"],
}


#: Most folders of a table before an append rewrites it as one.
MOST_FOLDERS = 16


class Conflict(RuntimeError):
    """Another job has written a table since it was read."""


class Store:
    """Tables of one root folder. Every write makes the next version."""

    def __init__(self, spark: SparkSession, root: str):
        ship(spark)
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def versions(self) -> list[int]:
        fs, p = self._fs(f"{self.root}/manifests")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """The folders of each table at a version; empty before the first write."""
        found = self.versions()
        if not found:
            return {}
        text = self.spark.read.text(f"{self.root}/manifests/{version if version is not None else found[-1]}.json", wholetext=True).first()[0]
        return json.loads(text)

    def read(self, table: str, bank: str | None = None, version: int | None = None) -> DataFrame:
        """A table at a version (the latest); a bank's folder alone is listed if one is named."""
        paths = self.manifest(version).get(table)
        if not paths:
            df = self.spark.createDataFrame([], SCHEMAS[table])
        else:
            df = self.spark.read.schema(SCHEMAS[table]).option("basePath", paths[0].rsplit("/", 1)[0]).parquet(*paths) if len(paths) == 1 else self._union(table, paths)
        return df if bank is None else df.filter(F.col("bank_id") == bank)

    def _union(self, table: str, paths: list[str]) -> DataFrame:
        out = None
        for p in paths:
            part = self.spark.read.schema(SCHEMAS[table]).parquet(p)
            out = part if out is None else out.unionByName(part)
        return out

    def _put(self, table: str, rows: DataFrame) -> str:
        fields = SCHEMAS[table].fields
        have = set(rows.columns)
        shaped = rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))
        path = f"{self.root}/data/{table}/{uuid.uuid4().hex}"
        writer = shaped.write
        (writer.partitionBy("bank_id") if "bank_id" in shaped.columns else writer).parquet(path)
        return path

    def version(self) -> int:
        """The latest version; 0 before the first write."""
        return (self.versions() or [0])[-1]

    def commit(self, changes: dict[str, list[str]], added: dict[str, str] | None = None, base: int | None = None) -> int:
        """Publish a version: ``changes`` are the new folders of tables, ``added`` a further folder of tables.

        What was added is put behind the latest version, whichever that is by
        then, so no append is lost. New contents rest on what was read: with
        ``base``, the version read, a table of ``changes`` that another job has
        written since raises ``Conflict``, and the caller reads and tries again.
        """
        then = self._at(base) if base is not None else {}
        while True:
            version = self.version()
            now = self._at(version)
            late = [t for t in changes if base is not None and now.get(t) != then.get(t)]
            if late:
                raise Conflict(f"written since version {base}: {', '.join(sorted(late))}")
            more = {t: [*now.get(t, []), path] for t, path in (added or {}).items()}
            if self._publish(version + 1, json.dumps(now | changes | more, sort_keys=True)):
                return version + 1

    def _at(self, version: int) -> dict[str, list[str]]:
        return self.manifest(version) if version else {}

    def _publish(self, version: int, body: str) -> bool:
        """Write a manifest under another name and rename it; false if the version is there already."""
        fs, target = self._fs(f"{self.root}/manifests/{version}.json")
        _, temporary = self._fs(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        fs.mkdirs(target.getParent())
        out = fs.create(temporary)
        out.write(bytearray(body.encode()))
        out.close()
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        hadoop = jvm.org.apache.hadoop.fs
        context = hadoop.FileContext.getFileContext(fs.makeQualified(target).toUri(), self.spark._jsc.hadoopConfiguration())
        try:  # this rename, unlike that of the file system, never replaces a file
            context.rename(fs.makeQualified(temporary), fs.makeQualified(target), gateway.new_array(hadoop.Options.Rename, 0))
        except Py4JJavaError as error:
            if "FileAlreadyExists" not in error.java_exception.getClass().getName():
                raise
            fs.delete(temporary, False)
            return False
        return True

    def append(self, tables: dict[str, DataFrame]) -> int:
        """Add rows to tables, all in one version."""
        version = self.commit({}, {t: self._put(t, df) for t, df in tables.items()})
        return self.compact() or version

    def compact(self, most: int = MOST_FOLDERS) -> int | None:
        """Rewrite tables of more than ``most`` folders as one; the new version, or none if there was nothing to do.

        If another job writes such a table meanwhile, its rows count and the
        table is left to the next append.
        """
        base = self.version()
        many = [t for t, paths in self._at(base).items() if len(paths) > most]
        if not many:
            return None
        try:
            return self.commit({t: [self._put(t, self.read(t, version=base))] for t in many}, base=base)
        except Conflict:
            return None

    def replace(self, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """New contents of whole tables, all in one version; ``base`` is the version they were read from."""
        return self.commit({t: [self._put(t, df)] for t, df in tables.items()}, base=base)

    def upsert(self, table: str, rows: DataFrame, update: bool = True) -> int:
        """Insert by key; rows with a known key replace the old ones, or are left out (``update`` false)."""
        base = self.version()
        return self.replace({table: upserted(self.read(table), rows, KEYS[table], update)}, base)

    def delete(self, *, bank: str | None = None, document: str | None = None, unit: str | None = None, fact_type: str | None = None) -> dict[str, int]:
        """Delete a unit, a document or a bank (of one fact type) with all that hangs on it; rows deleted by table."""
        base = self.version()
        units, condition = self.read("units"), F.lit(True)
        for column, value in (("bank_id", bank), ("document_id", document), ("unit_id", unit), ("fact_type", fact_type)):
            if value is not None:
                condition = condition & F.col(column).eqNullSafe(F.lit(value))
        gone = units.filter(condition).select("unit_id")
        changes = cascade({t: self.read(t) for t in ("units", "unit_entities", "links", "dictionary", "access_events")}, gone)
        if document is not None or bank is not None and fact_type is None:
            for t in ("documents", "chunks"):
                c = F.lit(True) if bank is None else F.col("bank_id") == bank
                changes[t] = self.read(t).filter(~(c if document is None else c & (F.col("document_id") == document)))
        if bank is not None and document is None and unit is None and fact_type is None:
            for t in ("banks", "entities", "schemas", "schema_edges", "fingerprints", "operations", "working_memory", "model_config"):
                changes[t] = self.read(t).filter(F.col("bank_id") != bank)
        before = {t: self.read(t).count() for t in changes}
        self.replace(changes, base)
        return {t: n - self.read(t).count() for t, n in before.items()}

    def backup(self, target: str, version: int | None = None) -> dict[str, int]:
        """Copy a version's tables to another root; rows by table. One version id is one snapshot."""
        other, paths, counts = Store(self.spark, target), {}, {}
        for t in self.manifest(version):
            rows = self.read(t, version=version)
            paths[t], counts[t] = [other._put(t, rows)], rows.count()
        other.commit(paths)
        return counts

    def restore(self, source: str) -> int:
        """All tables of a backup, as the next version."""
        other = Store(self.spark, source)
        return self.replace({t: other.read(t) for t in other.manifest()})


def upserted(old: DataFrame, new: DataFrame, keys: list[str], update: bool = True) -> DataFrame:
    """The rows of ``old`` and ``new`` with one row a key (null keys are equal)."""
    fresh = new.dropDuplicates(keys)
    if not update:
        return old.unionByName(_without(fresh, old, keys), allowMissingColumns=True)
    return _without(old, fresh, keys).unionByName(fresh, allowMissingColumns=True)


def _without(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    named = others.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return rows.join(named, on, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the units ``gone`` (unit_id) and the rows that depend on them."""
    columns = {"units": ["unit_id"], "unit_entities": ["unit_id"], "links": ["src", "dst"], "dictionary": ["engram_id"], "access_events": ["unit_id"]}
    out = {}
    for t, df in tables.items():
        for c in columns[t]:
            df = df.join(gone.select(F.col("unit_id").alias(c)), c, "left_anti")
        out[t] = df
    return out


def tracked_documents(docs: DataFrame, bank: str, doc_id: str, column: str) -> DataFrame:
    """Documents with the digest of their content, by which a change is seen."""
    return docs.select(F.col(doc_id).cast("string").alias("document_id"), F.col(bank).cast("string").alias("bank_id"), F.col(column).alias("original_text"), F.sha2(F.coalesce(column, F.lit("")), 256).alias("content_hash"))


def trace(rows: DataFrame, kind: str, bank: str) -> DataFrame:
    """Trace rows: everything else as JSON."""
    rest = [c for c in rows.columns if c != bank]
    body = F.to_json(F.struct(*rest))
    return rows.select(F.sha2(F.concat_ws("|", F.lit(kind), bank, body), 256).alias("trace_id"), F.col(bank).cast("string").alias("bank_id"), F.lit(kind).alias("kind"), F.current_timestamp().alias("at"), body.alias("body"))
