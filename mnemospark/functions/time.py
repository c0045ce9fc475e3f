"""Date phrases and time windows as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MONTHS = "january february march april may june july august september october november december".split()
#: Words for yesterday and today in five languages.
YESTERDAY = "yesterday|gestern|hier|ayer|ieri"
TODAY = r"today|heute|aujourd'hui|hoy|oggi"
#: Numbers of a vague count.
COUPLE, FEW = 2, 3


def phrase_window(query: Column, reference: Column) -> Column:
    """struct(start, end) of the date phrase in a query, as dates; null if there is none.

    The first rule that matches decides: yesterday and today, a couple or few
    days, weeks or months ago, last week, month, year, weekend or weekday, and
    a month with a year.
    """
    q, day = F.lower(query), reference.cast("date")
    month = F.regexp_extract(q, rf"\b({'|'.join(MONTHS)})\s+(\d{{4}})\b", 1)
    year = F.regexp_extract(q, rf"\b({'|'.join(MONTHS)})\s+(\d{{4}})\b", 2)
    number = F.array_position(F.array(*map(F.lit, MONTHS)), month).cast("int")
    first = F.make_date(F.when(year != "", year).cast("int"), number, F.lit(1))
    week = F.date_trunc("week", reference).cast("date")

    def span(a: Column, b: Column) -> Column:
        return F.struct(a.cast("date").alias("start"), b.cast("date").alias("end"))

    rules = [(rf"\b({YESTERDAY})\b", span(F.date_sub(day, 1), F.date_sub(day, 1))), (rf"\b({TODAY})\b", span(day, day))]
    for word, n in (("couple( of)?", COUPLE), ("few", FEW)):
        for unit, size in (("day", 1), ("week", 7), ("month", 30)):
            at = F.date_sub(day, n * size)
            rules.append((rf"\b(a )?{word} {unit}s? ago\b", span(F.date_sub(at, size // 2), F.date_add(at, size // 2))))
    rules += [
        (r"\blast week\b", span(F.date_sub(week, 7), F.date_sub(week, 1))),
        (r"\blast month\b", span(F.add_months(F.trunc(day, "month"), -1), F.date_sub(F.trunc(day, "month"), 1))),
        (r"\blast year\b", span(F.add_months(F.trunc(day, "year"), -12), F.date_sub(F.trunc(day, "year"), 1))),
        (r"\blast weekend\b", span(F.date_sub(week, 2), F.date_sub(week, 1))),
    ]
    for name in "monday tuesday wednesday thursday friday saturday sunday".split():
        at = F.date_sub(F.next_day(day, name[:3]), 7)
        at = F.when(at == day, F.date_sub(day, 7)).otherwise(at)
        rules.append((rf"\blast {name}\b", span(at, at)))
    out = F.when(F.lit(False), span(day, day))
    for pattern, value in rules:
        out = out.when(q.rlike(pattern), value)
    return out.when(month != "", span(first, F.last_day(first)))


def relative_date(text: Column, reference: Column) -> Column:
    """Midnight of the first relative day that a fact's text names; null if there is none."""
    q, day = F.lower(text), F.date_trunc("day", reference)
    days = F.regexp_extract(q, r"\b(\d{1,3}) days? ago\b", 1)
    return (
        F.when(q.rlike(rf"\b({YESTERDAY}|last night)\b"), day - F.expr("INTERVAL 1 DAY"))
        .when(q.rlike(rf"\b({TODAY}|this morning|tonight)\b"), day)
        .when(q.rlike(r"\btomorrow\b"), day + F.expr("INTERVAL 1 DAY"))
        .when(days != "", day - F.make_dt_interval(F.when(days != "", days).cast("int")))
        .when(q.rlike(r"\blast week\b"), day - F.expr("INTERVAL 7 DAY"))
        .when(q.rlike(r"\bnext week\b"), day + F.expr("INTERVAL 7 DAY"))
        .when(q.rlike(r"\blast month\b"), F.add_months(day, -1).cast("timestamp"))
    )


def overlaps(start: Column, end: Column, mentioned: Column, low: Column, high: Column) -> Column:
    """A range that meets the window, or any of its dates inside it; false where all are null."""
    inside = [F.coalesce((c >= low) & (c <= high), F.lit(False)) for c in (mentioned, start, end)]
    return F.coalesce((start <= high) & (end >= low), F.lit(False)) | inside[0] | inside[1] | inside[2]


#: A cell of the time tree has 2**32 microseconds (72 minutes); a node of the next level has 256 of the level below.
CELL_BITS, LEVEL_BITS, LEVELS = 32, 8, 4


def cell(at: Column) -> Column:
    """The cell of the time tree that a timestamp is in."""
    return F.shiftright(F.unix_micros(at), CELL_BITS)


def above(cell_: Column, bits: int = LEVEL_BITS) -> Column:
    """The nodes (level, node) of the time tree that hold a cell, one of each level; a node has 2**``bits`` of the level below."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(cell_, k * bits).alias("node")) for k in range(LEVELS * LEVEL_BITS // bits)))


def cover(first: Column, last: Column) -> Column:
    """The fewest nodes of the time tree that hold the cells from ``first`` to ``last`` and no others; none if there are none.

    Of the nodes of a level that lie between both, those are taken that no node
    of the level above takes along.
    """

    def inside(level: int) -> tuple[Column, Column]:
        bits = level * LEVEL_BITS
        return F.shiftright(first + ((1 << bits) - 1), bits), F.shiftright(last + 1, bits) - 1

    def nodes(level: int, low: Column, high: Column) -> Column:
        made = F.transform(F.sequence(low, F.greatest(low, high)), lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))
        return F.when(low <= high, made).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))

    found = []
    for level in range(LEVELS):
        low, high = inside(level)
        if level == LEVELS - 1:
            found.append(nodes(level, low, high))
            break
        up, down = inside(level + 1)
        some = up <= down
        found += [nodes(level, low, F.when(some, F.shiftleft(up, LEVEL_BITS) - 1).otherwise(high)), nodes(level, F.when(some, F.shiftleft(down + 1, LEVEL_BITS)).otherwise(high + 1), high)]
    return F.concat(*found)


def covered(rows: DataFrame, first: str, last: str, bits: int) -> DataFrame:
    """Each row once for each node (level, node) of ``cover``, of a tree whose nodes have 2**``bits`` of the level below.

    For very many ranges: the fewer ``bits``, the fewer nodes (with 2, about one
    and a half for each doubling of the range), and all of it is generated code.
    """
    up, down = (lambda n: f"shiftright({first} + shiftleft(1L, {bits} * ({n})) - 1, {bits} * ({n}))"), (lambda n: f"shiftright({last} + 1, {bits} * ({n})) - 1")
    at = rows.filter(F.col(first) <= F.col(last)).selectExpr("*", f"explode(sequence(0, cast(log2({last} - {first} + 1) / {bits} + 0.001 AS int))) AS level")
    at = at.selectExpr("*", f"{up('level')} AS _low", f"{down('level')} AS _high", f"{up('level + 1')} AS _up", f"{down('level + 1')} AS _down")
    at = at.selectExpr("*", f"if(_up <= _down, shiftleft(_up, {bits}) - 1, _high) AS _left", f"if(_up <= _down, shiftleft(_down + 1, {bits}), _high + 1) AS _right")
    none = "cast(array() AS array<bigint>)"
    return at.selectExpr("*", f"explode(concat(if(_low <= _left, sequence(_low, _left), {none}), if(_right <= _high, sequence(_right, _high), {none}))) AS node").drop("_low", "_high", "_up", "_down", "_left", "_right")
