"""Chunks, facts and other rows made of texts."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.functions import text

CHUNK = 3000
SEPARATORS = ("\n\n", "\n", ". ", " ", "")


def split_text(value: str, size: int = CHUNK, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters that together are the text, cut at the coarsest separator that serves."""
    if len(value) <= size:
        return [value] if value else []
    sep, rest = separators[0], separators[1:]
    if not sep:
        return [value[i : i + size] for i in range(0, len(value), size)]
    out, held = [], ""
    parts = value.split(sep)
    for k, part in enumerate(parts):
        piece = part + (sep if k < len(parts) - 1 else "")
        if len(held) + len(piece) <= size:
            held += piece
            continue
        if held:
            out.append(held)
        held = piece
        if len(held) > size:
            *full, held = split_text(held, size, rest)
            out += full
    return out + [held] if held else out


def split_turns(value: str, size: int = CHUNK) -> list[str] | None:
    """Chunks of a JSON list of turns, cut between turns; None if the text is something else."""
    if not value.lstrip().startswith("["):
        return None
    try:
        turns = json.loads(value)
    except ValueError:
        return None
    if not isinstance(turns, list) or not turns or not all(isinstance(t, dict) for t in turns):
        return None
    out, held = [], []
    for t in turns:
        if held and len(json.dumps([*held, t], ensure_ascii=False)) > size:
            out.append(json.dumps(held, ensure_ascii=False))
            held = []
        held.append(t)
    return [*out, json.dumps(held, ensure_ascii=False)]


def chunks(docs: DataFrame, bank: str, doc_id: str, column: str, size: int = CHUNK) -> DataFrame:
    """chunk_id (bank_document_index), index and text of every chunk.

    A plain function gets some tens of texts at a time; an Arrow batch has
    10,000, and texts are long.
    """
    cut = F.udf(lambda v: (split_turns(v, size) or split_text(v, size)) if v else [], "array<string>", useArrow=False)
    rows = docs.select(F.col(bank).alias("bank_id"), F.col(doc_id).alias("document_id"), F.posexplode(cut(column)).alias("chunk_index", "chunk_text"))
    return rows.select(F.concat_ws("_", "bank_id", "document_id", "chunk_index").alias("chunk_id"), "bank_id", "document_id", "chunk_index", "chunk_text")


def sub_batches(docs: DataFrame, by: list[str], order: str, column: str, most: int = 600_000) -> DataFrame:
    """Batch numbers of documents by running characters: a batch is closed before it passes ``most``.

    A batch's length starts anew after each cut, so the fold is sequential
    within a group of ``by``; only ids and lengths are gathered for it.
    """
    rows = docs.select(*by, order, F.length(column).alias("chars"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", batch int"

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, total, batch, out = pdf.sort_values(order), 0, 0, []
        for n in pdf["chars"].fillna(0):
            if total and total + n > most:
                batch, total = batch + 1, 0
            total += n
            out.append(batch)
        return pdf.assign(batch=out)

    return rows.groupBy(*by).applyInPandas(fold, schema)


def sentences(value: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[.!?])\s+|\n+", value)) if s]


def extract_facts(chunks_: DataFrame, extractor: Callable[[str], list[str]] = sentences, most: int = CHUNK) -> DataFrame:
    """Facts of every chunk by a replaceable extractor; a chunk that is too long is halved and asked again."""

    def halves(value: str) -> list[str]:
        if len(value) <= most:
            return extractor(value)
        mid = value.rfind(" ", 0, len(value) // 2 + 1)
        mid = mid if mid > 0 else len(value) // 2
        return halves(value[:mid]) + halves(value[mid:])

    found = F.udf(lambda v: halves(v or ""), "array<string>", useArrow=False)
    return chunks_.select("chunk_id", F.posexplode(found("chunk_text")).alias("fact_index", "fact"))


def clean_facts(raw: DataFrame) -> DataFrame:
    """Facts made regular: empty and N/A are null, types fall back, and the text is put together.

    raw: what, when, who, why, fact_type, kind, occurred_start, occurred_end, reference.
    """
    blank = lambda c: F.when(F.upper(F.trim(F.col(c))).isin("", "N/A", "NA", "NONE", "NULL"), None).otherwise(F.trim(F.col(c)))
    out = raw.select(*(c for c in raw.columns if c not in ("what", "when", "who", "why")), *(blank(c).alias(c) for c in ("what", "when", "who", "why")))
    known = F.when(F.col("fact_type").isin("world", "experience", "opinion", "observation"), F.col("fact_type")).when(F.col("fact_type") == "assistant", "experience").otherwise("world")
    joined = F.concat_ws(" | ", "what", F.concat(F.lit("When: "), F.col("when")), F.concat(F.lit("Involving: "), F.col("who")), "why")
    start = F.when(F.col("kind") == "event", F.coalesce("occurred_start", "reference")).otherwise(F.col("occurred_start"))
    return out.withColumn("fact_type", known).withColumn("text", joined).withColumn("occurred_start", start).withColumn("occurred_end", F.when(F.col("kind") == "event", F.coalesce("occurred_end", start)).otherwise(F.col("occurred_end"))).filter(F.length("text") > 0)


def expand_sequences(units: DataFrame) -> DataFrame:
    """Rows of structured units: a fact alone, an action with its effect, or an experience with its outcome.

    units: unit_id, kind, fact, action, effect, expectation, outcome.
    """
    part = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("text"))
    parts = F.when(F.col("kind") == "action_effect", F.array(part("action", "action"), part("effect", "effect"))).when(F.col("kind") == "experience", F.array(part("expectation", "expectation"), part("outcome", "outcome"))).otherwise(F.array(part("fact", "fact")))
    rows = units.select("unit_id", "kind", F.posexplode(parts).alias("place", "part")).select("unit_id", "kind", "place", "part.role", "part.text")
    return rows.filter(F.col("text").isNotNull())


def offset_times(facts: DataFrame, by: list[str], order: str, times: list[str], seconds: int = 10) -> DataFrame:
    """Fact k of a content gets ``k`` x 10 seconds more on all its times, so that order shows in time."""
    k = F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1
    out = facts.withColumn("_k", k)
    for c in times:
        out = out.withColumn(c, F.col(c).cast("timestamp") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("_k") * seconds).cast("decimal(18,6)")))
    return out.drop("_k")


def parse_json(rows: DataFrame, column: str, schema: str, out: str) -> DataFrame:
    """A JSON column, fenced or not, as a struct; null where it does not parse."""
    return rows.withColumn(out, F.from_json(text.strip_fence(F.col(column)), schema, {"mode": "PERMISSIVE"}))
