import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemospark.llm import common, line_dedup, packing
from tests.llm.brute import dedup_lines

DOCS = "doc_id long, text string"


def rows_of(spark, docs):
    return spark.createDataFrame(docs, DOCS)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(3)
    common = ["Common Line", " common line\t", "ÄÖ x", "äö x", "É", "", "  ", "\x0bmenu", "x" * 300]
    out = [(k, "\n".join(rng.choice([*common, f"own {k} {j}", f"shared {rng.randrange(12)}"]) for j in range(rng.randrange(1, 90)))) for k in range(60)]
    out.append((99, "\n".join(rng.choice(["menu", f"own {j}", "Common Line"]) for j in range(5000))))
    return [*out, (100, None), (101, ""), (102, "\n\n"), (103, "Common line"), (104, "word " * 30_000)]


@pytest.mark.parametrize("limit", [24 << 20, 300, 0])
def test_line_dedup_against_brute_force(spark, docs, monkeypatch, limit):
    """Also where only some or no keys may be broadcast."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    marked = line_dedup.with_bitmaps(rows_of(spark, docs))
    got = {r.doc_id: (r.n, r.t) for r in marked.select("doc_id", line_dedup.n_dropped(F.col("dropped")).alias("n"), line_dedup.kept_text(F.coalesce("text", F.lit("")), F.col("dropped")).alias("t")).collect()}
    want = dedup_lines(docs)
    assert {d: t for d, (_, t) in got.items()} == {d: "\n".join(x) for d, x in want.items()}
    assert {d: n for d, (n, _) in got.items()} == {d: len((t or "").split("\n")) - len(want[d]) for d, t in docs}


def test_first_occurrence_stays(spark):
    docs = [(k, "same\nown " + str(k) + "\nsame") for k in range(1, 15)]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(rows_of(spark, docs), min_docs=2, keep_first=True).collect()}
    assert got[1] == "same\nown 1" and got[2] == "own 2"


def test_line_dedup_odd_tables(spark):
    assert line_dedup.dedup_lines(rows_of(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a", 1, "w")] * 12 + [(None, f"B\n{k}", 1, "w") for k in range(9)] + [(5, "a\nb", 2, "w")], "doc_id long, text string, pos int, word string")
    out = line_dedup.dedup_lines(df)  # "a" is in two documents, "b" in ten
    assert out.columns == df.columns and sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("None", "a")] * 12 + [("None", str(k)) for k in range(9)] + [("5", "a")])


def test_a_null_id_is_no_number(spark):
    df = spark.createDataFrame([(None, "a"), (-1, "a"), (-2, "b")], DOCS)
    got = line_dedup.dedup_lines(df, min_docs=2).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("-1", ""), ("-2", "b"), ("None", "")]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


TEXTS = ["", "Hello, world. Don't stop'. It's 3.5 o'clock!!. A.B.C.", "É è Ñ İstanbul ΣΑΣ. Σ", "a b c\x1cd\x0be", "<|endoftext|> x <|startoftext|>", "é. É, Å", "½. ²,", "'s. ,'s a.'t .,", "日本語。テキスト, ok.", "\t\n\r \x0c", "naïve ﬁne \U0001f600.", "x" * 50, "퟿. ​,"]


def test_ids_of_words_are_ids_of_texts(tokenizer):
    ids = packing.WordIds(tokenizer[1], most=40)
    for texts in (TEXTS, [" ".join(TEXTS), "\n".join(TEXTS)], [t.upper() for t in TEXTS]):
        for t, got in zip(texts, ids.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer[1].encode(t, add_special_tokens=False).ids, t


ODD = [*"abcXYZ019 .,'sStm!?-_<|>\n\t\r\x0b\x0c\x1c\x85\xa0éÉÑßŸıİİſKÅΣσς½²ⅷ日本ก́̊̈ﬁǅẞ’“”…—€😀​‍가각ᄀ", "<|endoftext|>", "<|startoftext|>", "'s", "'ll", "Y̊", "İ,", "don't", "<|"]


def test_ids_of_random_strings(tokenizer):
    """The tokenizer as it is loaded is the judge, special strings and all."""
    rng, ids = random.Random(5), packing.WordIds(tokenizer[1])
    assert ids.by_word
    for _ in range(100):
        texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(14))) for _ in range(500)]
        for t, got in zip(texts, ids.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer[1].encode(t, add_special_tokens=False).ids, t


def test_other_tokenizers_encode_whole_texts(tokenizer):
    import json

    from tokenizers import Tokenizer

    d = json.loads(tokenizer[1].to_str())
    d["normalizer"] = None
    other = Tokenizer.from_str(json.dumps(d))
    ids = packing.WordIds(other)
    assert not ids.by_word
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.encode(TEXTS)] == [other.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_packing_by_small_windows_and_odd_columns(spark, tokenizer):
    """Many flushes of a task, a null id, and columns named like those of the result."""
    docs = [(k if k else None, f"number {k} " * (k % 40)) for k in range(300)]
    df = rows_of(spark, docs).withColumns({"piece": F.lit("x"), "bin": F.lit(1), "length": F.lit(2)}).repartition(3)
    got = packing.pack_documents(df, tokenizer[0], capacity=256, window=20, fan_in=2).toPandas()
    assert len(got[got["doc_id"].isna()]) == 1 and got["length"].sum() == sum(len(tokenizer[1].encode(t, add_special_tokens=False).ids) + 1 for _, t in docs)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 256


def test_packing_is_whole_and_tight(spark, tokenizer):
    rng = random.Random(1)
    docs = [(k, " ".join(f"w{rng.randrange(99)}" for _ in range(int(rng.paretovariate(0.7) * 20) % 6000))) for k in range(400)]
    docs += [(900, None), (901, ""), (902, "tie"), (902, "tie")]
    got = packing.pack_documents(rows_of(spark, docs).repartition(7), tokenizer[0], fan_in=2, keep_tokens=True).toPandas()
    want, lengths = {}, []
    for d, t in docs:
        ids = np.array([*tokenizer[1].encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for p, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048].tobytes()
            want.setdefault((d, p), []).append((at, len(part) // 4, zlib.crc32(part)))
            lengths.append(len(part) // 4)
    have = {}
    for r in got.itertuples():
        have.setdefault((r.doc_id, r.piece), []).append((r.start, r.length, r.ids_crc32))
        assert zlib.crc32(r.token_bytes) == r.ids_crc32
    assert have == want
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].iloc[0] == 0 and (g["offset"].values[1:] == (g["offset"] + g["length"]).values[:-1]).all() and g["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= 1.02 * len(packing.best_fit(np.array(lengths))[2])


def test_best_fit():
    b, off, fill = packing.best_fit(np.array([5, 3, 2, 7, 8, 1, 4]), 10)
    assert sorted(fill) == [10, 10, 10] and all(off[i] + n <= 10 for i, n in enumerate([5, 3, 2, 7, 8, 1, 4])) and len(set(b)) == 3


def test_packing_of_nothing(spark, tokenizer):
    assert packing.pack_documents(rows_of(spark, []), tokenizer[0]).count() == 0
