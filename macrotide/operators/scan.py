"""Scans along an order: every row gets a state that all rows before it (or after it) decide.

A window without a key, or with one hot key, puts all rows of a sequence into one task. Here a
sequence is dealt over tasks by ranges of its order and cut into blocks of at most ``BLOCK`` rows. A scan has an
associative operation on elements: each block folds its rows into one element, the elements are folded along
the blocks of a range and along the ranges (at most one per shuffle partition), which gives every block the state at its
border; then every block finishes on its own. All of it is DataFrame functions; the largest array is a
block's rows, the blocks of one range, or one entry per range.

Rows that tie in the order stand in any one order; nulls come first. Key columns may be null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.handover import discard, written

#: Rows of a block; a power of two.
BLOCK = 1 << 10
#: Items that are walked in one go.
CHUNK = 1 << 4
#: Rows of one range have ids that agree above this bit.
_RANGE = 33

AT = ("_key", "_range", "_block")


@dataclass(frozen=True)
class Scan:
    """What a scan does, all as columns.

    ``lift(row)``: the element of a row. ``combine(a, b)``: the element of a, then b. ``apply(state, element)``:
    the state after an element; the state before the first one is null. ``state``: the type of a state.
    """

    lift: Callable[[Column], Column]
    combine: Callable[[Column, Column], Column]
    apply: Callable[[Column, Column], Column]
    state: str


def null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def blocks(df: DataFrame, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """A written table with a row per block: _key, _range, _block and _rows, the rows in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*(F.col(k) for k in keys)) if keys else F.struct(F.lit(0).alias("all"))
    dealt = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order).select(F.monotonically_increasing_id().alias("_id"), key.alias("_key"), F.struct(*df.columns).alias("_row"))
    size = BLOCK.bit_length() - 1
    cut = dealt.groupBy("_key", F.shiftright("_id", _RANGE).alias("_range"), F.shiftright("_id", size).alias("_block"))
    held = cut.agg(F.sort_array(F.collect_list(F.struct("_id", "_row"))).alias("_rows"))
    return written(held.withColumn("_rows", F.transform("_rows", lambda x: x["_row"])))


def _kinds(df: DataFrame, *columns: Column) -> list[str]:
    return [f.dataType.simpleString() for f in df.select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).schema]


def _folded(items: Column, kind: str, lift, combine) -> Column:
    step = lambda acc: lambda e: F.when(acc.isNull(), e).otherwise(combine(acc, e))
    return F.aggregate(items, null(kind), lambda acc, x: once(lift(x), step(acc)))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value evaluated a single time (a lambda over an array of one)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _steps(elements: Column, start: Column, scan: Scan) -> Column:
    """(before, after) of each element, in order. The result so far is copied at each step, so elements are few."""
    zero = F.struct(start.alias("now"), F.array().cast(f"array<struct<before:{scan.state},after:{scan.state}>>").alias("out"))

    def step(acc, x):
        return once(scan.apply(acc["now"], x), lambda after: F.struct(after.alias("now"), F.array_append(acc["out"], F.struct(acc["now"].alias("before"), after.alias("after"))).alias("out")))

    return F.aggregate(elements, zero, step, lambda acc: acc["out"])


def walked(df: DataFrame, items: Column, lift: Callable[[Column], Column], start: Column, scan: Scan, target: str) -> DataFrame:
    """df with the array (item, before, after) of an array's items: the state at each one without it and with it, from a start.

    Items are lifted once and taken ``CHUNK`` at a time: the chunks' elements give the state at each chunk, then each chunk finishes.
    Intermediate arrays are variables of lambdas, since columns of a projection may be evaluated anew for each use.
    """
    kind = _kinds(df, lift(F.get(items, F.lit(0))))[0]

    def in_chunks(elements):
        nth = F.sequence(F.lit(0), ((F.size(elements) - 1) / CHUNK).cast("int"))
        return once(F.transform(nth, lambda i: F.slice(elements, i * CHUNK + 1, CHUNK)), walk)

    def walk(chunks):
        starts = _steps(F.transform(chunks, lambda chunk: _folded(chunk, kind, lambda x: x, scan.combine)), start, scan)
        return F.flatten(F.zip_with(chunks, starts, lambda chunk, at: _steps(chunk, at["before"], scan)))

    def with_items(steps):
        return F.zip_with(items, steps, lambda item, at: F.struct(item.alias("item"), at["before"].alias("before"), at["after"].alias("after")))

    return df.withColumn(target, once(once(F.transform(items, lift), in_chunks), with_items))


def spread(items: str | Column, fields: Callable[[Column], dict[str, Column]]) -> Column:
    """A row per item, with these columns: were fields taken after an explosion, the items might be made anew for each."""
    return F.inline(F.transform(items, lambda x: F.struct(*(c.alias(name) for name, c in fields(x).items()))))


def _turned(items: Column, backwards: bool) -> Column:
    return F.reverse(items) if backwards else items


def elements(cut: DataFrame, scan: Scan, backwards: bool = False) -> DataFrame:
    """A written table (_key, _range, _block, element): one row per block."""
    kind = _kinds(cut, scan.lift(F.get("_rows", F.lit(0))))[0]
    return written(cut.select(*AT, _folded(_turned(F.col("_rows"), backwards), kind, scan.lift, scan.combine).alias("element")))


def borders(found: DataFrame, scan: Scan, backwards: bool = False) -> DataFrame:
    """A written table (_key, _range, _block, border): the state before each block (backwards: after it), from the blocks' elements.

    It is written so that its size is known when it is joined back: a small one is broadcast, and the rows stay where they are."""
    kind, same = found.schema["element"].dataType.simpleString(), lambda x: x["element"]

    def parts(of: DataFrame, name: str, *by: str) -> DataFrame:
        held = of.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(F.col(name).alias("at"), "element"))).alias("parts"))
        return held.withColumn("parts", _turned(F.col("parts"), backwards))

    ranges = parts(found, "_block", "_key", "_range")
    # one entry per range: no more than shuffle partitions
    whole = parts(ranges.select("_key", "_range", _folded(F.col("parts"), kind, same, scan.combine).alias("element")), "_range", "_key")
    starts = walked(whole, F.col("parts"), same, null(scan.state), scan, "steps").select("_key", spread("steps", lambda x: {"_range": x["item"]["at"], "start": x["before"]}))
    each = walked(ranges.join(starts, ["_key", "_range"]), F.col("parts"), same, F.col("start"), scan, "steps")
    return written(each.select("_key", "_range", spread("steps", lambda x: {"_block": x["item"]["at"], "border": x["before"]})))


def folded(cut: DataFrame, scan: Scan) -> DataFrame:
    """(_key, element): the element of each whole sequence."""
    found = cut.select(*AT, _folded(F.col("_rows"), _kinds(cut, scan.lift(F.get("_rows", F.lit(0))))[0], scan.lift, scan.combine).alias("element"))
    kind, same = found.schema["element"].dataType.simpleString(), lambda x: x["element"]
    for below, above in (("_block", ["_key", "_range"]), ("_range", ["_key"])):
        found = found.groupBy(*above).agg(F.sort_array(F.collect_list(F.struct(below, "element"))).alias("parts")).select(*above, _folded(F.col("parts"), kind, same, scan.combine).alias("element"))
    return found


def states(df: DataFrame, order: Sequence[str], scan: Scan, keys: Sequence[str] = (), backwards: bool = False) -> DataFrame:
    """df with the columns _before and _after: the state at each row without the row and with it. A written table."""
    cut = blocks(df, order, keys)
    found = elements(cut, scan, backwards)
    edges = borders(found, scan, backwards)
    each = walked(cut.join(edges, list(AT)), _turned(F.col("_rows"), backwards), scan.lift, F.col("border"), scan, "steps")
    row = lambda x: {c: x["item"][c] for c in df.columns} | {"_before": x["before"], "_after": x["after"]}
    result = written(each.select(spread("steps", row)))
    discard(cut, found, edges)
    return result


def last_value(column: str, kind: str, skip_nulls: bool = False) -> Scan:
    """The state is the value of the last row (or the last one that is not null)."""
    later = (lambda a, b: F.coalesce(b, a)) if skip_nulls else (lambda a, b: b)
    return Scan(lambda row: F.struct(row[column].alias("v")), lambda a, b: F.struct(later(a["v"], b["v"]).alias("v")), lambda s, e: later(s, e["v"]), kind)


def previous(df: DataFrame, order: Sequence[str], column: str, target: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with the value that the row before holds, null for the first one."""
    return states(df, order, last_value(column, dict(df.dtypes)[column]), keys).withColumnRenamed("_before", target).drop("_after")


def carried(df: DataFrame, order: Sequence[str], column: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with the nulls of a column filled by the last value before."""
    return states(df, order, last_value(column, dict(df.dtypes)[column], True), keys).withColumn(column, F.col("_after")).drop("_before", "_after")


def running_total(column: str) -> Scan:
    """The state is the sum so far."""
    return Scan(lambda row: row[column].cast("long"), lambda a, b: a + b, lambda s, e: F.coalesce(s, F.lit(0).cast("long")) + e, "bigint")


def islands(df: DataFrame, order: Sequence[str], column: str, keys: Sequence[str] = ()) -> DataFrame:
    """df with island: the number, from 1, of the run of equal values that a row belongs to. Nulls equal each other."""
    kind = dict(df.dtypes)[column]
    differ = lambda a, b: (~a.eqNullSafe(b)).cast("long")
    scan = Scan(
        lambda row: F.struct(row[column].alias("first"), row[column].alias("last"), F.lit(0).cast("long").alias("changes")),
        lambda a, b: F.struct(a["first"].alias("first"), b["last"].alias("last"), (a["changes"] + b["changes"] + differ(a["last"], b["first"])).alias("changes")),
        lambda s, e: F.struct(e["last"].alias("last"), F.when(s.isNull(), 1 + e["changes"]).otherwise(s["island"] + differ(s["last"], e["first"]) + e["changes"]).alias("island")),
        f"struct<last:{kind},island:bigint>",
    )
    return states(df, order, scan, keys).withColumn("island", F.col("_after.island")).drop("_before", "_after")
