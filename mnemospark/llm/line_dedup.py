"""Line dedup on keep bitmaps, with DataFrame functions only.

Lines become 128-bit hashes of their keys. The hashes are range-partitioned and
sorted by document and position, so that one streaming pass over each key's
rows finds its first occurrence and counts its documents. Hashes are spread
evenly, so the ranges' bounds are known without sampling. A key is dealt over
``salts`` parts of its range by document, so a line that stands in a third of
all documents is never one task's work; the parts' counts are then added up per
key. What returns is not text but a bitmap per document: words of 64 lines, only
those in which a line is dropped.

The repeated keys are broadcast while they fit. Beyond that the keys found in
most documents still are, as many as fit, and the lines of all others are
shuffled, none of which can be hot.

Defined cases: a null or empty text is one empty line, which has no key and
stays; rows of equal id and text are one document and get the same bitmap, rows
of one id (or none) with other texts are documents of their own, and so are a
null id and any number; ties in document id are ordered by the text's hash and
position, a null id counts as -1; extra columns pass through unchanged; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemospark.llm.common import SPACE_CHARS, SPACE_CLASS, ascii_lower, cut, fresh, join_counted, small, text_of

#: Repeated lines that make a text a copy, if half of it is in them.
COPY_LINES = 5
#: Groups that a text is compared in.
SEEDS = 8


def line_key(line: Column) -> Column:
    """Stripped of white space at both ends, A-Z in lower case."""
    return ascii_lower(_stripped(line))


def _stripped(line: Column) -> Column:
    return F.trim(line, F.lit(SPACE_CHARS))


def _hashed(docs: DataFrame, text: str, key: list[str], min_chars: int) -> DataFrame:
    """One row per line with a key: document key, position and two hashes."""
    lines = docs.select(*key, F.posexplode_outer(F.split(text_of(docs, text), "\n")).alias("pos", "line"))  # outer: no filter that splits twice
    # Stripped once and lower-cased once: a filter on the whole key would be moved down and compute it again.
    lines = lines.select(*key, "pos", _stripped(F.col("line")).alias("t")).filter(F.length("t") >= min_chars)
    lines = lines.select(*key, "pos", ascii_lower(F.col("t")).alias("k"))
    return lines.select(*key, "pos", F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(1), F.col("k")).alias("h2"))


def repeated_keys(lines: DataFrame, key: list[str], min_docs: int, salts: int = 16) -> DataFrame:
    """h1, h2, n_docs and first (document and position) of keys in ``min_docs`` documents or more."""
    n = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*key), F.lit(salts)).cast("int")
    # The range of an even hash: its upper 31 bits times the number of ranges.
    part = F.pmod(F.shiftright(F.shiftrightunsigned("h1", 33) * n, 31).cast("int") + F.col("salt") * max(1, n // salts), F.lit(n))
    ranged = lines.withColumn("salt", salt).withColumn("part", part).repartitionById(n, "part")
    run = Window.partitionBy("part", "h1", "h2", "salt").orderBy(*key, "pos")
    same = F.lit(True)
    for k in key:
        same = same & F.lag(k).over(run).eqNullSafe(F.col(k))
    opens = ranged.withColumn("opens", ~same).filter("opens")  # a key's first row in each document
    first = F.min(F.struct(*key, "pos")).alias("first")
    return opens.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), first).filter(F.col("n_docs") >= min_docs)


def with_bitmaps(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, bitmap: str = "dropped") -> DataFrame:
    """The documents with a column ``bitmap`` of the lines to drop (null: none).

    ``min_docs``: a key in so many documents is repeated. ``keep_first``: the
    first occurrence, by document id and position, stays.
    """
    key = [fresh("id", docs.columns), fresh("hash", docs.columns)]
    # A document's key is its id and its text's hash, so rows that repeat an id keep bitmaps of their own.
    number = F.col(f"`{doc_id}`").cast("long")
    keyed = docs.withColumns({key[0]: F.coalesce(number, F.lit(-1)), key[1]: F.xxhash64(F.col(f"`{text}`"), number.isNull())})
    lines = _hashed(keyed, text, key, min_chars)
    found = cut(repeated_keys(lines, key, min_docs))
    dropped = join_counted(lines, found, ["h1", "h2"], "n_docs", 64, [*key, "pos"])
    if keep_first:
        at = F.struct(*key, "pos")
        dropped = dropped.filter(at != F.col("first"))
    words = dropped.groupBy(*key, (F.col("pos") / 64).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("mask"))
    bitmaps = cut(words.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("word", "mask"))).alias(bitmap)))
    return keyed.join(small(bitmaps, 48 + 32 * F.size(bitmap)), key, "left").select(*(F.col(f"`{c}`") for c in docs.columns), F.col(bitmap))


def n_dropped(bitmap: Column) -> Column:
    return F.coalesce(F.aggregate(bitmap, F.lit(0).cast("long"), lambda a, x: a + F.bit_count(x["mask"]).cast("long")), F.lit(0).cast("long"))


def kept_text(text: Column, bitmap: Column) -> Column:
    """The text without the dropped lines; whole if there are none."""

    def chunk(lines: Column, e: Column, i: Column) -> Column:
        """The lines since the bitmap's word before, and those that this word leaves."""
        done = F.when(i == 0, F.lit(0)).otherwise((F.get(bitmap, i - 1)["word"] + 1) * 64)
        left = F.filter(F.slice(lines, e["word"] * 64 + 1, 64), lambda _, j: F.getbit(e["mask"], j) == 0)
        return F.concat(F.slice(lines, done + 1, e["word"] * 64 - done), left)

    def kept(lines: Column) -> Column:
        tail = F.slice(lines, (F.element_at(bitmap, -1)["word"] + 1) * 64 + 1, F.size(lines))
        return F.array_join(F.concat(F.flatten(F.transform(bitmap, lambda e, i: chunk(lines, e, i))), tail), "\n")

    # Through an array of one, so that the text is split once and not for every word of the bitmap.
    return F.when(bitmap.isNull(), text).otherwise(F.get(F.transform(F.array(F.split(text, "\n")), kept), F.lit(0)))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_docs: int = 10, min_chars: int = 1, keep_first: bool = False, spare_copies: bool = False) -> DataFrame:
    """The documents with their repeated lines cut out of the text; columns as they were.

    ``spare_copies``: a text of which no word would be left stays whole, and so
    does a copy: a text that would lose half of its characters or more in at
    least ``COPY_LINES`` lines, and that is a near copy of another such text.
    Texts that only share lines lose them, however many these are; a passage of
    fewer lines goes however much of its document it is.
    """
    bitmap = fresh("dropped", docs.columns)
    marked = with_bitmaps(docs, text, doc_id, min_docs, min_chars, keep_first, bitmap)
    cleaned = fresh("cleaned", marked.columns)
    marked = marked.withColumn(cleaned, kept_text(text_of(marked, text), F.col(bitmap)))
    as_it_was = F.col(bitmap).isNull()
    if not spare_copies:
        return marked.withColumn(text, F.when(as_it_was, F.col(f"`{text}`")).otherwise(F.col(cleaned))).drop(bitmap, cleaned)
    nothing_left = F.length(_stripped(F.col(cleaned))) == 0
    mostly = ~as_it_was & ~nothing_left & (n_dropped(F.col(bitmap)) >= COPY_LINES) & (2 * F.length(cleaned) <= F.length(f"`{text}`"))
    key = F.xxhash64(f"`{text}`")
    own = F.when(nothing_left, F.lit(0)).otherwise(F.length(cleaned))
    pool = marked.filter(mostly | (~as_it_was & nothing_left)).select(F.col(f"`{text}`").alias("text"), own.alias("own"))
    copies, copy = copied_texts(pool), fresh("copy", marked.columns)
    spared = marked.join(small(copies.withColumnRenamed("key", copy), 24), (key == F.col(copy)) & mostly, "left")
    as_it_was = as_it_was | nothing_left | F.col(copy).isNotNull()
    return spared.withColumn(text, F.when(as_it_was, F.col(f"`{text}`")).otherwise(F.col(cleaned))).drop(bitmap, cleaned, copy)


def copied_texts(texts: DataFrame, width: int = 5, percent: int = 75) -> DataFrame:
    """key, the hash of each text that occurs twice or is a near copy of another one, with DataFrame functions only.

    ``texts``: text, and own (what no other text has of it, in characters). A text
    stands in ``SEEDS`` groups, each by the least hash of its word shingles under
    one seed; near copies miss all of them with a probability below 2e-5. Of each
    group it is compared, on full sets, with two texts: the one that has least of
    its own, which is what the others were copied from or is nearest to it, and
    one chosen by hash. So a text makes 2 x ``SEEDS`` pairs at most, however large
    its groups are.
    """
    words = F.array_remove(F.split(ascii_lower(F.col("text")), SPACE_CLASS + "+"), "")
    one = texts.groupBy(F.xxhash64("text").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min("own").alias("own"), F.first("text").alias("text")).withColumn("words", words)
    shingles = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1))), lambda i: F.xxhash64(F.slice("words", i, width)))
    sets = cut(one.filter(F.size("words") > 0).select("key", "n", "own", F.array_distinct(shingles).alias("set")))
    least = F.explode(F.array(*(F.struct(F.lit(k).alias("seed"), F.array_min(F.transform("set", lambda h, k=k: F.xxhash64(F.lit(k), h))).alias("least")) for k in range(SEEDS))))
    stand = cut(sets.select("key", "own", least.alias("g")).select("key", "own", "g.*"))
    heads = cut(stand.groupBy("seed", "least").agg(F.array(F.min(F.struct("own", "key"))["key"], F.min(F.struct(F.xxhash64("key", "seed"), "key"))["key"]).alias("heads"), F.count(F.lit(1)).alias("size")).filter("size > 1"))
    pairs = join_counted(stand.select("seed", "least", "key"), heads, ["seed", "least"], "size", 80, ["key"]).select("key", F.explode("heads").alias("head")).filter("key <> head").distinct()
    pairs = cut(pairs)
    wanted = pairs.groupBy("head").agg(F.count(F.lit(1)).alias("size"))
    of_heads = cut(wanted.join(sets.select(F.col("key").alias("head"), F.col("set").alias("of_head")), "head"))
    widest = of_heads.agg(F.max(F.size("of_head"))).first()[0] or 0
    both = join_counted(pairs.join(sets.select("key", "set"), "key"), of_heads, ["head"], "size", 64 + 8 * widest, ["key"])
    shared = F.size(F.array_intersect("set", "of_head"))
    alike = cut(both.filter(100 * shared >= percent * (F.size("set") + F.size("of_head") - shared)).select("key", "head"))
    return cut(sets.filter("n > 1").select("key").union(alike.select("key")).union(alike.select("head")).distinct())
