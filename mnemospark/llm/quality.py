"""Quality rules as a short-circuit cascade.

Every rule looks at one feature of a text. On a sample of all texts, chosen by a
hash of their ids, tasks measure the rules' cost (seconds a text) and selectivity
(share of texts rejected); only the sums reach the driver. The rules run by
rejection per cost, each only on texts that no rule before rejected. The order
changes only how soon a bad text is given up, never the verdict.

The base measures are taken of every text; the rules that reuse them cost
nothing more.

Defined cases: a null or empty text has no words and fails the base; repeated
rows give repeated rows; rules of equal rate keep the listed order; an empty
table gives an empty result and the listed order; extra columns are ignored.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import text_of, tune
from mnemospark.llm.words import FACTORS, HASHES, claim, mix

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Texts of which costs and selectivities are measured, about.
SAMPLE_ROWS = 1000
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, failed_rule string, n_rules_run int"
_LETTER = re.compile(rb"[A-Za-z\x80-\xff]")


class Text:
    """A text and its base measures."""

    __slots__ = ("text", "words", "n", "word_chars", "symbols", "dup_lines", "lines", "repeated")

    def __init__(self, text: str):
        self.text, self.words = text, text.encode().split()
        self.n = len(self.words)
        self.word_chars = len(text) - sum(map(text.count, SPACES))
        self.symbols = sum(map(text.count, SYMBOLS))
        lines = [x for x in text.split("\n") if x.strip(SPACES)]
        self.lines, self.dup_lines = len(lines), len(lines) - len(set(lines))
        self.repeated = self._repeated() if self.n > 3 else 0

    def _repeated(self) -> int:
        """Words in windows of three that occur twice or more."""
        h, n = HASHES.of(self.words), self.n - 2
        g = mix(h[:n] * np.uint64(FACTORS[0]) + h[1 : n + 1] * np.uint64(FACTORS[1]) + h[2:] * np.uint64(FACTORS[2]))
        order = np.sort(g)
        twice = order[1:][order[1:] == order[:-1]]
        if not len(twice):
            return 0
        at = np.searchsorted(twice, g)
        hit = twice[np.minimum(at, len(twice) - 1)] == g
        seen = np.zeros(self.n, bool)
        seen[:n] |= hit
        seen[1 : n + 1] |= hit
        seen[2:] |= hit
        return int(seen.sum())

    @property
    def base_failed(self) -> bool:
        return self.n < 50 or 100 * self.repeated > 50 * self.n


def _upper_share(t: Text) -> float:
    """Characters that lower-casing changes, among those in words."""
    low = t.text.lower()
    if len(low) != len(t.text):  # a letter whose lower case is two characters
        return sum(map(str.isupper, t.text)) / max(1, t.word_chars)
    a, b = (np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in (t.text, low))
    return int((a != b).sum()) / max(1, t.word_chars)


def _wordless_share(t: Text) -> float:
    """Words without a letter; any byte beyond ASCII counts as one."""
    return sum(1 for w in t.words if not _LETTER.search(w)) / max(1, t.n)


def _distinct_share(t: Text) -> float:
    """Of the words among the first occurrences, weighed down for long texts (Guiraud's root measure)."""
    return len(set(t.words)) / max(1.0, t.n**0.5)


#: name and test (true: rejected), in the order used where nothing else decides.
RULES: list[tuple[str, Callable[[Text], bool]]] = [
    ("symbols", lambda t: t.symbols > 0.1 * max(1, t.n)),
    ("word_length", lambda t: not 2.5 <= t.word_chars / max(1, t.n) <= 12),
    ("repeated_lines", lambda t: t.dup_lines > 0.5 * max(1, t.lines)),
    ("exclamation", lambda t: t.text.count("!") > 0.3 * max(1, t.n)),
    ("upper_case", lambda t: _upper_share(t) > 0.6),
    ("no_letters", lambda t: _wordless_share(t) > 0.3),
    ("few_different_words", lambda t: _distinct_share(t) < 1.5),
]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rule number, texts, rejected texts and seconds, of a task's part of the sample."""
    claim("words")
    texts, rejected, seconds = 0, [0] * len(RULES), [0.0] * len(RULES)
    for batch in batches:
        sample = [t for t in map(Text, batch.column(0).to_pylist()) if not t.base_failed]
        texts += len(sample)
        for k, (_, test) in enumerate(RULES):
            began = time.perf_counter()
            rejected[k] += sum(1 for t in sample if test(t))
            seconds[k] += time.perf_counter() - began
    if texts:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(RULES)), pa.int32()), pa.array([texts] * len(RULES), pa.int64()), pa.array(rejected, pa.int64()), pa.array(seconds)], ["rule", "texts", "rejected", "seconds"])


def plan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rows: int = SAMPLE_ROWS) -> list[dict]:
    """The rules with their sampled cost, selectivity and rate, best first.

    ``rows``: the size of the sample, which only the order of the rules depends
    on. A small table is measured whole.
    """
    tune(docs.sparkSession)
    share = rows / max(1, docs.count())
    chosen = docs.filter(F.pmod(F.xxhash64(F.col(f"`{doc_id}`").cast("string")), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)))
    measured = chosen.select(text_of(docs, text).alias("text")).mapInArrow(_measure, "rule int, texts long, rejected long, seconds double")
    sums = {r["rule"]: r for r in measured.groupBy("rule").agg(*(F.sum(c).alias(c) for c in ("texts", "rejected", "seconds"))).collect()}
    found = []
    for k, (name, _) in enumerate(RULES):
        n, rejected, seconds = (sums[k][c] for c in ("texts", "rejected", "seconds")) if k in sums else (0, 0, 0.0)
        found.append({"rule": name, "listed": k, "cost": seconds / max(1, n) + 1e-9, "selectivity": rejected / max(1, n)})
    return ranked([r | {"rate": r["selectivity"] / r["cost"]} for r in found])


def ranked(found: list[dict]) -> list[dict]:
    """Rules by rate; those that reject nothing by cost; ties as listed."""
    return sorted(found, key=lambda r: (-r["rate"], r["cost"] if r["rate"] == 0 else 0, r["listed"]))


def _judge(order: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("words")
        rules = [RULES[k] for k in order]
        names = [f.strip().split(" ")[0] for f in SCHEMA.split(",")]
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.string(), pa.int32()]
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t, failed, ran = Text(text), None, 0
                base = t.base_failed
                if base:
                    failed = "base"
                else:
                    for name, test in rules:
                        ran += 1
                        if test(t):
                            failed = name
                            break
                rows.append((doc_id, t.n, t.word_chars, t.symbols, t.dup_lines, t.repeated, base, failed is None, failed, ran))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: list[dict] | None = None) -> DataFrame:
    """Measures and verdict of every document; ``order`` as made by ``plan``."""
    tune(docs.sparkSession)
    chosen = [r["listed"] for r in (order if order is not None else plan(docs, doc_id, text))]
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return source.mapInArrow(_judge(chosen), SCHEMA)
