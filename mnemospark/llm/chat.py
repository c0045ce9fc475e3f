"""Chat formatting by token-level assembly.

Every turn is ``[INST]role[/INST]text</s>`` and a conversation begins with
``<s>``. The four control strings have reserved ids, which are spliced between
segments that were encoded on their own, so no text can ever encode to one.
Where a control string stands in a role or text, one more ``~`` is put behind
its first character (``</s>`` to ``<~/s>``, ``<~/s>`` to ``<~~/s>``), which
keeps the formatted string unambiguous too and can be undone.

Turns are encoded one by one; only ids are gathered per conversation. The loss
mask covers the texts of assistant turns. It is kept as spans, whose places are
prefix sums of the segments' lengths.

Defined cases: a null text or role is empty; a null turn comes first; rows that
repeat a turn are turns of their own, ordered by turn, role and ids; a null
conv_id is a conversation; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import tune

#: The control strings, in the order of their reserved ids.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
BEGIN, END, OPEN, SHUT = range(4)
_TO_ESCAPE = re.compile(r"([<\[])(~*)(s>|/s>|INST\]|/INST\])")
_ESCAPED = re.compile(r"([<\[])~(~*)(s>|/s>|INST\]|/INST\])")
TURNS = "conv_id long, turn long, role string, ids array<int>, lead int, body int"
FORMATTED = "array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return _TO_ESCAPE.sub(r"\1~\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


class Codec:
    """A byte-level vocabulary of ranks and, behind it, the reserved ids."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.first = max(table.values()) + 1
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def encode(self, text: str) -> list[int]:
        """Ids of a segment; its control strings are escaped first."""
        return self.encoding.encode_ordinary(escape(text))

    def segments(self, ids: list[int]) -> list[list[int] | int]:
        """Runs of ordinary ids (also empty ones) and, between them, the numbers of the control strings."""
        out: list[list[int] | int] = [[]]
        for i in ids:
            if i >= self.first:
                out += [i - self.first, []]
            else:
                out[-1].append(i)
        return out

    def plain(self, ids: list[int]) -> str:
        return self.encoding.decode_bytes(ids).decode("utf-8", "surrogatepass")

    def formatted(self, ids: list[int]) -> str:
        return "".join(CONTROL[s] if isinstance(s, int) else self.plain(s) for s in self.segments(ids))

    def turns(self, ids: list[int]) -> list[tuple[str, str]]:
        """Roles and texts, read back from a conversation's ids."""
        parts = self.segments(ids)
        return [(unescape(self.plain(parts[k + 1])), unescape(self.plain(parts[k + 3]))) for k in range(len(parts)) if parts[k] == OPEN and isinstance(parts[k], int)]


_CODECS: dict[int, Codec] = {}


def _codec(ranks, pattern: str) -> Codec:
    """The worker's codec; building one takes longer than a batch."""
    key = hash((len(ranks), ranks[:64], ranks[-64:], pattern))
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(ranks, pattern)
    return _CODECS[key]


def _encode(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        end, start, shut = (codec.first + k for k in (END, OPEN, SHUT))
        for batch in batches:
            ids, lead, body = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                r, t = codec.encode(role), codec.encode(text)
                ids.append([start, *r, shut, *t, end])
                lead.append(len(r) + 2)
                body.append(len(t) if role == "assistant" else -1)
            columns = [*batch.columns[:3], pa.array(ids, pa.list_(pa.int32())), pa.array(lead, pa.int32()), pa.array(body, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "role", "ids", "lead", "body"])

    return run


def format_conversations(rows: DataFrame, ranks_path: str, pattern: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, input_ids and loss_spans (token start and end of what is learned) of each conversation."""
    spark = rows.sparkSession
    tune(spark)
    with open(ranks_path, "rb") as f:
        data = f.read()
    ranks = spark.sparkContext.broadcast(data)
    first = max(int(line.split()[1]) for line in data.splitlines()) + 1
    source = rows.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    encoded = source.mapInArrow(_encode(ranks, pattern), TURNS)
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "ids", "lead", "body")))
    grouped = encoded.groupBy("conv_id").agg(turns.alias("turns"))
    # Prefix sums: where each turn begins, with the opening <s> before the first.
    begins = F.aggregate(
        "turns",
        F.struct(F.lit(1).alias("at"), F.array().cast(FORMATTED).alias("spans")),
        lambda a, t: F.struct(
            (a["at"] + F.size(t["ids"])).alias("at"),
            F.when(t["body"] < 0, a["spans"]).otherwise(F.concat(a["spans"], F.array(F.struct((a["at"] + t["lead"]).alias("start"), (a["at"] + t["lead"] + t["body"]).alias("end"))))).alias("spans"),
        ),
    )
    ids = F.concat(F.array(F.lit(first + BEGIN)), F.flatten(F.transform("turns", lambda t: t["ids"])))
    return grouped.select("conv_id", ids.alias("input_ids"), begins["spans"].alias("loss_spans"))


def _read(ranks, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(ranks.value, pattern)
        for batch in batches:
            n, digest, chars, loss_digest, formatted = [], [], [], [], []
            for ids, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = codec.turns(ids)
                loss = "".join(unescape(codec.plain(ids[s["start"] : s["end"]])) for s in spans)
                n.append(len(turns))
                digest.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest())
                chars.append(len(loss))
                loss_digest.append(hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest())
                formatted.append(len(codec.formatted(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(chars, pa.int64()), pa.array(loss_digest, pa.string()), pa.array(formatted, pa.int64())],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return run


def read_back(formatted: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """What the output of ``format_conversations`` says when it is decoded: counts and digests."""
    with open(ranks_path, "rb") as f:
        ranks = formatted.sparkSession.sparkContext.broadcast(f.read())
    return formatted.select("conv_id", "input_ids", "loss_spans").mapInArrow(_read(ranks, pattern), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
