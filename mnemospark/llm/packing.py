"""Best-fit packing of token sequences (hierarchical residual packing).

One pass over the documents tokenizes, cuts pieces and packs each partition's
pieces by best fit decreasing. Nearly full bins are final. Underfull bins then
become items themselves: groups of ``fan_in`` partitions are merged into one,
packed again, and so on up the tree. What moves between rounds is a bin's id
and length, never tokens. A task holds at most ``window`` items at once.

Ids are those of the tokenizer as it is loaded, so its special strings in a text
have their own ids.

Defined cases: a null or empty text is one document of the single separator
id; a null doc_id stays null; repeated rows are packed as often as they occur; an empty table gives an
empty result; ties in length are taken in input order; extra columns of the
input are ignored.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import cut, text_of, tune
from mnemospark.llm.words import CACHES, claim

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, filled long, token_bytes binary"
LINKS = "child long, parent long, shift long, filled long"


#: Byte-level vocabularies show a byte as a character: printable ones as themselves, the others from 256 on.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: chr(b if b in _SHOWN else 256 + i) for i, b in enumerate(sorted(range(256), key=lambda b: (b in _SHOWN, b)))}
#: The definition of a tokenizer whose texts may be encoded word by word, without its vocabulary.
BY_WORD = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "model": {"type": "BPE", "dropout": None, "continuing_subword_prefix": None, "byte_fallback": False, "ignore_merges": False},
}
#: Full stops and commas that end a word: a boundary for the tokenizer too, if a letter or digit stands before.
_TAIL = re.compile(r"(?<=[0-9A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff])([.,]+)(?=[ \n\t\r]|\Z)")
#: Whether a text has characters beyond Latin letters and common marks; the others are as they are in NFC and have one small letter each.
_BEYOND = re.compile("[^\0-\u012f\u0131-\u024f\u2010-\u2027\u20ac]")


def by_word(definition: dict) -> bool:
    """Whether a tokenizer encodes each word on its own, as ``words_of`` takes for granted."""
    model = {k: definition["model"].get(k) for k in BY_WORD["model"]}
    return {k: model if k == "model" else definition.get(k) for k in BY_WORD} == BY_WORD


def words_of(text: str) -> list[str]:
    """Parts of a text whose ids, put together in order, are the text's ids.

    The tokenizer composes (NFC), lower-cases each character and then splits at
    white space and between letters and marks. Lower-casing and cutting marks off
    here first, so that fewer different words are met, is done only where no
    character can make a difference.
    """
    if text.isascii() or not _BEYOND.search(text):
        text = _TAIL.sub(r" \1", text.lower())
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class WordIds(dict):
    """Little-endian uint32 ids of the words met so far, in two generations.

    When the young generation is full it becomes the old one, which bounds the
    memory and keeps the frequent words.
    """

    def __init__(self, tokenizer, most: int = 250_000):
        super().__init__()
        definition = json.loads(tokenizer.to_str())
        self.tokenizer, self.most, self.old = tokenizer, most, {}
        self.by_word, self.added = by_word(definition), [t["content"].lower() for t in definition["added_tokens"]]
        self.starts = {a[:2] for a in self.added} | {a[:2].upper() for a in self.added}

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the words that are new, in one call."""
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
        new = set().union(*texts)
        new.difference_update(self)
        old, miss = self.old, []
        for w in new:
            ids = old.get(w)
            if ids is None:
                miss.append(w)
            else:
                self[w] = ids
        # A word of letters alone is one part for the tokenizer, so its merges can be asked for directly.
        merge, rest = self.tokenizer.model.tokenize, []
        for w in miss:
            if w.isascii():
                if w.isalpha() and w.islower():
                    self[w] = array("I", [t.id for t in merge(w)]).tobytes()
                else:
                    rest.append(w)
            elif w.isalpha() and not _BEYOND.search(w) and w == w.lower():
                self[w] = array("I", [t.id for t in merge(w.encode().decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
            else:
                rest.append(w)
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            self[w] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text: by words, or of the whole where it holds a special string (in any case) or the tokenizer is another."""
        whole = [not self.by_word or any(a in t for a in self.starts) and any(a in t.lower() for a in self.added) for t in texts]
        words = [[] if w else words_of(t) for w, t in zip(whole, texts, strict=True)]
        self.learn(words)
        get = self.__getitem__
        for is_whole, w, t in zip(whole, words, texts, strict=True):
            yield array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() if is_whole else b"".join(map(get, w))


#: The words of the last tokenizer that this worker used; kept between its tasks.
_WORKER: dict[int, WordIds] = {}
CACHES["packing"] = _WORKER.clear


def word_ids(model: bytes) -> WordIds:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    claim("packing")
    key = zlib.crc32(model)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = WordIds(Tokenizer.from_str(model.decode()))
    return _WORKER[key]


def best_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best fit decreasing: bin and offset of each item, and the bins' fill.

    Bins of equal free space are a stack, and a bit mask of the free spaces in
    use finds the tightest fit in one machine operation on a short integer.
    """
    n = len(lengths)
    bins, offsets, filled = np.empty(n, np.int64), np.empty(n, np.int64), []
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    order = np.argsort(-lengths, kind="stable")
    for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            stack = stacks[free]
            b = stack.pop()
            if not stack:
                mask ^= 1 << free
        else:
            free, b = capacity, len(filled)
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        left = free - size
        if left:
            if not stacks[left]:
                mask |= 1 << left
            stacks[left].append(b)
    return bins, offsets, np.asarray(filled, np.int64)


def _first_bin(level: int) -> int:
    """The first bin id of this task: level, partition and a running number."""
    return (level << 58) | (TaskContext.get().partitionId() << 34)


def _local(model, capacity: int, window: int, keep_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, next_bin, width = word_ids(model.value), _first_bin(0), 4 * capacity

        def emit(rows: list[tuple], b, off, fill) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(cols[k], pa.int64()) for k in (2, 3, 4)), pa.array(b, pa.int64()), pa.array(off, pa.int64()), pa.array(fill, pa.int64()), pa.array(cols[5], pa.binary())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "filled", "token_bytes"],
            )

        held: list[tuple] = []
        full: list[tuple] = []

        def pack() -> pa.RecordBatch:
            nonlocal next_bin
            b, off, filled = best_fit(np.fromiter((r[3] for r in held), np.int64, len(held)), capacity)
            out = emit(held, b + next_bin, off, filled[b])
            next_bin += len(filled)
            held.clear()
            return out

        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), ids.encode(batch.column(1).to_pylist()), strict=True):
                data += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(data), width)):
                    part = data[at : at + width]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_tokens else None)
                    (full if len(part) == width else held).append(row)
            if full:
                n = len(full)
                yield emit(full, range(next_bin, next_bin + n), [0] * n, [capacity] * n)
                next_bin += n
                full.clear()
            if len(held) >= window:
                yield pack()
        if held:
            yield pack()

    return run


def _merge(level: int, capacity: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        next_bin, ids, sizes, n = _first_bin(level), [], [], 0

        def pack() -> pa.RecordBatch:
            nonlocal next_bin, n
            child, size = np.concatenate(ids), np.concatenate(sizes)
            order = np.argsort(child)  # the result does not depend on how rows arrived
            child, size = child[order], size[order]
            b, off, filled = best_fit(size, capacity)
            out = pa.RecordBatch.from_arrays([pa.array(x) for x in (child, b + next_bin, off, filled[b])], ["child", "parent", "shift", "filled"])
            next_bin += len(filled)
            ids.clear(), sizes.clear()
            n = 0
            return out

        for batch in batches:
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            sizes.append(batch.column(1).to_numpy(zero_copy_only=False))
            n += batch.num_rows
            if n >= window:
                yield pack()
        if n:
            yield pack()

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, near_full: float = 0.995, fan_in: int = 16, window: int = 400_000, keep_tokens: bool = False) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Returns one row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, and token_bytes (the piece's uint32 ids) if
    ``keep_tokens``.

    ``near_full``: a bin filled to this share is final. ``fan_in``: partitions
    merged into one per round. The rounds end when one partition is left, or
    when a round frees less than 0.1 % of the bins it was given.
    """
    spark = docs.sparkSession
    tune(spark)
    with open(tokenizer_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    source = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    pieces = cut(source.mapInArrow(_local(model, capacity, window, keep_tokens), PIECES))
    limit = int(near_full * capacity)
    bins = pieces.filter((F.col("offset") == 0) & (F.col("filled") < limit)).select(F.col("bin").alias("child"), F.col("filled").alias("size"))
    width, level, chain = max(1, pieces.rdd.getNumPartitions()), 0, None
    count = bins.count()
    while count:
        level += 1
        width = max(-(-width // fan_in), -(-count // window))
        links = cut(bins.repartition(width).mapInArrow(_merge(level, capacity, window), LINKS))
        step = links.select("child", "parent", "shift")
        if chain is None:
            chain = step
        else:
            up = step.select(F.col("child").alias("parent"), F.col("parent").alias("top"), F.col("shift").alias("more"))
            chain = chain.join(up, "parent", "left").select("child", F.coalesce("top", "parent").alias("parent"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
        bins = links.filter((F.col("shift") == 0) & (F.col("filled") < limit)).select(F.col("parent").alias("child"), F.col("filled").alias("size"))
        before, count = count, links.filter("shift = 0").count()
        if width == 1 or before - count < 0.001 * before:
            break
        count = bins.count()
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *["token_bytes"] * keep_tokens]
    if chain is None:
        return pieces.withColumnRenamed("bin", "sequence_id").select(columns)
    moved = pieces.join(chain, pieces["bin"] == chain["child"], "left")
    return moved.withColumn("sequence_id", F.coalesce("parent", "bin")).withColumn("offset", F.col("offset") + F.coalesce("shift", F.lit(0))).select(columns)
