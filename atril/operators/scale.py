"""Helpers that keep operators whole and balanced when data or keys are large.

* `query_blocks` - the only route to an explicit broadcast: the small side is cut
  into hashed blocks whose row and byte size is measured first.
* `maybe_in` - leaves rows without a partner out before a shuffle, by a filter of bits of bounded size.
* `carry_last`, `preceding_rows`, `trailing_sum` - window functions for keys that
  may hold a large share of all rows.  A plain window puts a whole key in one
  task; these cut every key into position ranges ("pieces"), compute inside the
  piece, and pass only a per-piece summary from piece to piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from atril import settings as S


def query_blocks(
    queries: DataFrame,
    key: str,
    max_rows: int = S.QUERY_BLOCK_ROWS,
    max_bytes: int = S.QUERY_BLOCK_BYTES,
    width: Column | None = None,
) -> Iterator[DataFrame]:
    """Cut `queries` into hashed blocks small enough to broadcast.

    One aggregate measures rows and bytes; a table of any size is then handled
    by as many passes as its size asks for, never by a larger broadcast.
    """
    measure = queries.agg(
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(width if width is not None else F.lit(64)), F.lit(0)).cast("long").alias("b"),
    ).first()
    blocks = max(1, math.ceil(measure.n / max_rows), math.ceil(measure.b / max_bytes))
    if blocks == 1:
        yield queries
        return
    blocks = math.ceil(blocks * 1.25)
    tagged = queries.withColumn("_block", F.pmod(F.xxhash64(F.col(key)), F.lit(blocks)))
    for b in range(blocks):
        yield tagged.where(F.col("_block") == b).drop("_block")


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """Rows ranked 1..n per key.  The rank filter is planned as a group limit that
    runs before the shuffle, so a hot key sends at most n rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


#: Words of 64 bits in a filter of `maybe_in`, at most.
SLOTS = 2**20


def _marked(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """`df` with `_maybe`: whether `column` may be among `values`; where it is, never false."""
    bits = [f"shiftleft(1L, int(shiftrightunsigned(_hash, {at}) & 63))" for at in (20, 26, 32)]
    slot, mask = F.expr(f"_hash & {SLOTS - 1}L"), F.expr(" | ".join(bits))
    held = values.select(F.xxhash64(column).alias("_hash")).select(slot.alias("_slot"), mask.alias("_mask"))
    held = F.broadcast(held.groupBy("_slot").agg(F.bit_or("_mask").alias("_held")))
    hashed = df.withColumn("_hash", F.xxhash64(column)).withColumns({"_slot": slot, "_mask": mask})
    return hashed.join(held, "_slot", "left").withColumn("_maybe", F.expr("coalesce(_held & _mask = _mask, false)"))


def maybe_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """Rows of `df` whose `column` may be among `values`; few others, and none is lost.

    A value sets three bits in one of SLOTS words.  Only words with a bit are sent to the tasks: never more than SLOTS, and no
    more than there are values.  Fuller words let more rows through.
    """
    return _marked(df, column, values).where("_maybe").select(*df.columns)


def surely_not_in(df: DataFrame, column: str, values: DataFrame) -> DataFrame:
    """The other rows of `df`: their `column` is not among `values`."""
    return _marked(df, column, values).where("NOT _maybe").select(*df.columns)


def sketch(values: Column, name: str = "sketch") -> list[Column]:
    """256 bits of an array of numbers, one for each value, as four columns."""

    def word(i: int) -> Column:
        def bit(v: Column) -> Column:
            h = F.xxhash64(v)
            at = F.shiftright(h, 2).bitwiseAND(63).cast("int")
            return F.when(h.bitwiseAND(3) == i, F.call_function("shiftleft", F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(values, F.lit(0).cast("long"), lambda held, v: held.bitwiseOR(bit(v)))

    return [word(i).alias(f"{name}_{i}") for i in range(4)]


def may_hold(whole: str, part: str) -> Column:
    """Whether the values behind sketch `part` may all be among those behind `whole`."""
    return F.expr(" AND ".join(f"{whole}_{i} & {part}_{i} = {part}_{i}" for i in range(4)))


def _pieces(df: DataFrame, keys: list[str], position: Column, span: int) -> DataFrame:
    cut = df.withColumn("_pos", position.cast("long"))
    return cut.withColumn("_piece", F.floor(F.col("_pos") / F.lit(span))).repartition(*keys, "_piece")


def carry_last(
    df: DataFrame, keys: list[str], position: Column, value: Column, out: str, span: int
) -> DataFrame:
    """Adds `out`: the last non-NULL `value` at a strictly smaller position of the key."""
    cut = _pieces(df, keys, position, span).withColumn("_val", value)
    inside = Window.partitionBy(*keys, "_piece").orderBy("_pos").rangeBetween(Window.unboundedPreceding, -1)
    summary = cut.groupBy(*keys, "_piece").agg(
        F.max_by(F.when(F.col("_val").isNotNull(), F.col("_val")),
                 F.when(F.col("_val").isNotNull(), F.col("_pos"))).alias("_tail")
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys, "_piece", F.last("_tail", ignorenulls=True).over(earlier).alias("_carried")
    ).where(F.col("_carried").isNotNull())
    here = F.last("_val", ignorenulls=True).over(inside)
    return (
        cut.withColumn("_here", here)
        .join(carried, [*keys, "_piece"], "left")
        .withColumn(out, F.coalesce("_here", "_carried"))
        .drop("_here", "_carried", "_val", "_pos", "_piece")
    )


def preceding_rows(
    df: DataFrame, keys: list[str], position: Column, fields: Column, n: int, out: str, span: int
) -> DataFrame:
    """Adds `out`: array of the `fields` of up to n preceding rows, oldest first.

    Positions must be unique inside a key.  A piece hands at most its n last rows
    to later pieces.
    """
    cut = _pieces(df, keys, position, span).withColumn("_f", fields)
    inside = Window.partitionBy(*keys, "_piece").orderBy("_pos")
    ranked = cut.select(*keys, "_piece", "_pos", "_f").withColumn(
        "_r", F.row_number().over(Window.partitionBy(*keys, "_piece").orderBy(F.desc("_pos")))
    ).where(F.col("_r") <= n)
    tails = ranked.groupBy(*keys, "_piece").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "_f"))), lambda s: s["_f"]).alias("_tail")
    )
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(-n, -1)
    carried = tails.select(
        *keys, "_piece", F.flatten(F.collect_list("_tail").over(earlier)).alias("_carried")
    ).where(F.size("_carried") > 0).withColumn("_carried", F.slice("_carried", F.greatest(F.size("_carried") - n, F.lit(0)) + 1, n))
    here = F.collect_list("_f").over(inside.rowsBetween(-n, -1))
    joined = cut.withColumn("_here", here).join(carried, [*keys, "_piece"], "left")
    both = F.concat(F.coalesce("_carried", F.slice("_here", 1, 0)), F.col("_here"))
    return (
        joined.withColumn("_both", both)
        .withColumn(out, F.slice("_both", F.greatest(F.size("_both") - n, F.lit(0)) + 1, n))
        .drop("_both", "_here", "_carried", "_f", "_pos", "_piece")
    )


def trailing_sum(
    df: DataFrame, keys: list[str], position: Column, value: Column, width: int, out: str
) -> DataFrame:
    """Adds `out`: sum of the integer `value` over positions [p - width, p] of the same key.

    A row matters to its own range of length `width` and to the next one only, so
    every (key, range) group is complete with one copy of each row as context.  The copy
    stands `width` later, where it leaves the sum; three running sums then give the result. A
    frame with two moving ends would be added up anew for every row.
    """
    order = Window.partitionBy(*keys, "_piece").orderBy("_at")
    until, before = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(Window.unboundedPreceding, -1)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own, context = F.when(F.col("_own"), F.col("_v")), F.when(~F.col("_own"), F.col("_v"))

    def held(of: Callable[[Column], Column]) -> Column:
        ends = [F.coalesce(of(c).over(w), F.lit(0)) for c, w in ((own, until), (context, whole), (context, before))]
        return ends[0] + ends[1] - ends[2]

    pos = df.withColumn("_pos", position.cast("long")).withColumn("_v", value).where(F.col("_pos").isNotNull())
    home = F.floor(F.col("_pos") / F.lit(width))
    return (
        pos.withColumn("_own", F.explode(F.array(F.lit(True), F.lit(False))))
        .withColumn("_piece", F.when(F.col("_own"), home).otherwise(home + 1))
        .withColumn("_at", F.when(F.col("_own"), F.col("_pos")).otherwise(F.col("_pos") + width))
        .withColumns({"_n": held(F.count), out: held(F.sum)})
        .where("_own").withColumn(out, F.when(F.col("_n") > 0, F.col(out)))
        .drop("_pos", "_v", "_own", "_piece", "_at", "_n")
    )
