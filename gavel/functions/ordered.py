"""Ordered operators over groups of any size.

Most groups are small: a transcript is one bounded row, a meeting some thousand sentences. For them the plain
form is best, one shuffle on the group key and one window. A turn table may however hold one meeting with a
third of all rows, and such a window would put it into one task. `segment_rows` therefore checks the largest
group (an aggregate over the key column alone) and returns

* None when every group fits in a segment: plain windows over the group;
* a segment size otherwise: windows over (group, segment), where a segment is a stretch of that many values of
  the order column. Bounded look-back (`with_halo`) copies the last rows of a segment into the next one.
  Unbounded look-back (`running_total`, `fill_forward`) aggregates per segment first and joins the state of
  everything before it to the segment's rows. The input of such a two-pass step is stored once in the shared
  checkpoint folder, so that chained steps do not compute their input again and again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gavel.session import cut_lineage

SEGMENT_ROWS = 65_536
SEGMENT = "_segment"
HALO = "_halo"


def segment_rows(df: DataFrame, keys: Sequence[str], limit: int = SEGMENT_ROWS) -> int | None:
    """None when no group has more than `limit` rows, else `limit`."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return limit if not sizes.where(F.col("n") > limit).isEmpty() else None


def segment_of(order: str, rows: int) -> Column:
    return F.floor(F.col(order) / F.lit(rows)).cast("long")


def window(keys: Sequence[str], order: str, rows: int | None) -> WindowSpec:
    return Window.partitionBy(*keys, *([] if rows is None else [SEGMENT])).orderBy(order)


def with_halo(df: DataFrame, order: str, lookback: int, rows: int | None) -> DataFrame:
    """In segmented form, add the segment and copy the last `lookback` rows of each segment into the next one.

    `order` must be dense inside a group (0, 1, 2, ...), as given by the turn parser or `number_rows`.
    """
    if rows is None:
        return df
    own = segment_of(order, rows)
    near_end = (F.col(order) % F.lit(rows)) >= F.lit(rows - lookback)
    targets = F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))
    return df.withColumn(SEGMENT, F.explode(targets)).withColumn(HALO, F.col(SEGMENT) != own)


def drop_halo(df: DataFrame, rows: int | None) -> DataFrame:
    return df if rows is None else df.where(~F.col(HALO)).drop(HALO, SEGMENT)


def _carried(
    base: DataFrame, keys: Sequence[str], state: Column, before: Column
) -> DataFrame:
    """Join to every row `_carry`: `before` (a window expression over `_state`) of its segment's predecessors.

    One row per (group, segment) meets the window over a group, so the largest group's window holds its row
    count divided by the segment size.
    """
    per_segment = base.groupBy(*keys, SEGMENT).agg(state.alias("_state"))
    carry = per_segment.select(*keys, SEGMENT, before.alias("_carry")).where(F.col("_carry").isNotNull())
    return base.join(carry, [*keys, SEGMENT], "left")


def _earlier_segments(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: str, value: Column, out: str, rows: int | None
) -> DataFrame:
    """Add `out`: the last non-null `value` of the group strictly before the current row."""
    w = window(keys, order, rows).rowsBetween(Window.unboundedPreceding, -1)
    if rows is None:
        return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
    base = cut_lineage(df.withColumn(SEGMENT, segment_of(order, rows)).withColumn("_value", value))
    last = F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order)))
    joined = _carried(base, keys, last, F.last("_state", ignorenulls=True).over(_earlier_segments(keys)))
    filled = joined.withColumn(out, F.coalesce(F.last("_value", ignorenulls=True).over(w), F.col("_carry")))
    return filled.drop("_value", "_carry", SEGMENT)


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, values: dict[str, Column], rows: int | None
) -> DataFrame:
    """Add one inclusive running sum per entry of `values`, in group order."""
    w = window(keys, order, rows).rowsBetween(Window.unboundedPreceding, 0)
    if rows is None:
        return df.select("*", *[F.sum(v.cast("long")).over(w).alias(out) for out, v in values.items()])
    base = cut_lineage(
        df.select("*", *[v.cast("long").alias(f"_v_{out}") for out, v in values.items()]).withColumn(
            SEGMENT, segment_of(order, rows)
        )
    )
    state = F.struct(*[F.sum(f"_v_{out}").alias(out) for out in values])
    earlier = _earlier_segments(keys)
    before = F.struct(*[F.sum(F.col(f"_state.{out}")).over(earlier).alias(out) for out in values])
    joined = _carried(base, keys, state, before)
    sums = [
        (F.coalesce(F.col(f"_carry.{out}"), F.lit(0)) + F.sum(f"_v_{out}").over(w)).alias(out) for out in values
    ]
    return joined.select("*", *sums).drop("_carry", SEGMENT, *[f"_v_{out}" for out in values])


def number_rows(df: DataFrame, keys: Sequence[str], order: str, out: str, rows: int | None) -> DataFrame:
    """Add `out`: 1, 2, 3, ... inside each group by a non-negative integer order column."""
    if rows is None:
        return df.withColumn(out, F.row_number().over(window(keys, order, None)).cast("long"))
    return running_total(df, keys, order, {out: F.lit(1)}, rows)


def numbered_by_sort(df: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """Add `out`: 0, 1, 2, ... over all rows in this order, by a distributed sort whose result is stored.

    The driver gets one count per partition of the sort, and no group is numbered by a single task.
    """
    rows = cut_lineage(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    before, offsets = 0, []
    for r in rows.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).orderBy("_p").collect():
        offsets.append((r[0], before))
        before += r.n
    starts = F.broadcast(df.sparkSession.createDataFrame(offsets, "_p long, _before long"))
    row = F.col("_m").bitwiseAND((1 << 33) - 1)
    return rows.withColumn("_p", part).join(starts, "_p").withColumn(out, F.col("_before") + row).drop("_p", "_m", "_before")
