"""Replaceable models: embeddings, reranker, date analyzer, text generation, hooks.

The stand-ins are deterministic and need no files, so every plan runs whole.
"""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemospark.functions import time

_TOKEN = regex.compile(r"[\p{L}\p{N}_]+")


class Embedder(ABC):
    """Texts to vectors of one length."""

    dimensions: int

    @abstractmethod
    def encode(self, texts: list[str]) -> np.ndarray: ...

    def column(self, text: Column) -> Column:
        """The vectors of a text column, a batch at a time."""
        own = self

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def run(values: pd.Series) -> pd.Series:
            return pd.Series(list(own.encode([v or "" for v in values]).astype(np.float32)))

        return run(text)


class HashingEmbedder(Embedder):
    """Signed feature hashing of words, unit length; the same on every machine."""

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            for w in _TOKEN.findall(t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[i, h % self.dimensions] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, n, out=out, where=n > 0)


class Reranker(ABC):
    """Scores of (query, text) pairs."""

    @abstractmethod
    def predict(self, queries: list[str], texts: list[str]) -> list[float]: ...

    def column(self, query: Column, text: Column) -> Column:
        own = self

        @F.pandas_udf(T.DoubleType())
        def run(q: pd.Series, t: pd.Series) -> pd.Series:
            return pd.Series(own.predict([x or "" for x in q], [x or "" for x in t]), dtype=float)

        return run(query, text)


class OverlapReranker(Reranker):
    """Share of the query's words in the text, as a logit."""

    def predict(self, queries: list[str], texts: list[str]) -> list[float]:
        out = []
        for q, t in zip(queries, texts, strict=True):
            a, b = set(_TOKEN.findall(q.lower())), set(_TOKEN.findall(t.lower()))
            out.append(6 * len(a & b) / len(a) - 3 if a else -3.0)
        return out


def rerank_text(text: Column, context: Column, date: Column) -> Column:
    """What a reranker reads: date, context and text."""
    return F.concat_ws(" ", F.when(date.isNotNull(), F.concat(F.lit("[Date: "), F.date_format(date, "yyyy-MM-dd"), F.lit("]"))), F.when(F.length(context) > 0, F.concat(context, F.lit(":"))), text)


class DateAnalyzer:
    """The date window of a query column by rules; replace ``window`` for a model."""

    def window(self, query: Column, reference: Column) -> Column:
        return time.phrase_window(query, reference)


class TextModel(ABC):
    """Text generation, with the tier that a task asks for."""

    @abstractmethod
    def generate(self, prompt: str, tier: str = "small") -> str: ...


class FirstSentence(TextModel):
    """Answers with the prompt's last line's first sentence."""

    def generate(self, prompt: str, tier: str = "small") -> str:
        line = next((x for x in reversed(prompt.splitlines()) if x.strip()), "")
        return line.split(". ")[0].strip()


class Hooks:
    """Callables before and after an operation; a hook before may refuse by raising."""

    def __init__(self):
        self.before: list[Callable[[str, dict], None]] = []
        self.after: list[Callable[[str, dict, object], None]] = []

    def run(self, name: str, arguments: dict, work: Callable[[], object]) -> object:
        for h in self.before:
            h(name, arguments)
        result = work()
        for h in self.after:
            h(name, arguments, result)
        return result


class Registry:
    """Retrieval strategies by name, and which one a bank uses."""

    def __init__(self, default: str = "push"):
        self.strategies: dict[str, Callable[..., DataFrame]] = {}
        self.banks: dict[str, str] = {}
        self.default = default

    def add(self, name: str, strategy: Callable[..., DataFrame]) -> None:
        self.strategies[name] = strategy

    def of(self, bank: str) -> Callable[..., DataFrame]:
        return self.strategies[self.banks.get(bank, self.default)]
