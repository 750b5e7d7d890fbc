"""Ordered scans of keys of any size.

Keys are counted first (partial sums, one row a key). Where none has over `most` rows a scan is a window by key. Where some have, they are
dealt into segments by quantiles of their order (a sketch made by partial aggregation), and every other key is one segment. Each segment is scanned by
a window of its own; what it hands on (its greatest value, its sum, its last value) is one row, which is folded along the key and joined back to the later
segments. So the rows are shuffled once, by key and segment, and no task holds a hot key. Rows of one key and one place in the order stay together.

A Scan is a frame and how it is dealt; each step gives a Scan with one column more, so that several steps share one shuffle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEGMENT = "_segment"
#: Rows that a key may have in one segment, and segments of a key that has more.
MOST, PARTS = 1 << 20, 256


def scan(rows: DataFrame, key: str, order: tuple[str, ...], most: int = MOST, parts: int = PARTS) -> Scan:
    """A scan of the rows of each key in order; the first column of the order is a number, rows without it come first."""
    hot = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(key)
    if hot.isEmpty():
        return Scan(rows, key, order, (key,))
    by = F.col(order[0])
    shares = [i / parts for i in range(1, parts)]
    edges = rows.join(hot, key, "left_semi").groupBy(key).agg(F.array_distinct(F.percentile_approx(by, shares, 20 * parts)).alias("_edges"))
    later = F.size(F.filter("_edges", lambda x: x <= by))
    dealt = rows.join(edges, key, "left").withColumn(SEGMENT, F.when(F.col("_edges").isNull() | by.isNull(), 0).otherwise(later)).drop("_edges")
    return Scan(dealt, key, order, (key, SEGMENT))


@dataclass(frozen=True)
class Scan:
    rows: DataFrame
    key: str
    order: tuple[str, ...]
    by: tuple[str, ...]

    def _step(self, value: Column, name: str, own: Callable, handed: Callable, fold: Callable, both: Callable) -> Scan:
        """`own` is the value's window expression within a segment, `handed` a segment's aggregate, `fold` what becomes of those of earlier
        segments, `both` the column of own and folded (null in a key's first segment)."""
        valued = self.rows.withColumn("_value", value)
        window = W.partitionBy(*self.by).orderBy(*self.order)
        if len(self.by) == 1:
            made = valued.withColumn(name, both(own(window), F.lit(None).cast(valued.select(handed()).schema[0].dataType)))
        else:
            earlier = W.partitionBy(self.key).orderBy(SEGMENT).rowsBetween(W.unboundedPreceding, -1)
            each = valued.groupBy(*self.by).agg(handed().alias("_carried")).withColumn("_carried", fold("_carried").over(earlier))
            # first segments get nothing, so what is joined has a row for each further segment of a hot key alone
            carried = each.where(F.col(SEGMENT) > 0).repartition(*self.by)
            made = valued.join(carried, list(self.by), "left").withColumn(name, both(own(window), F.col("_carried"))).drop("_carried")
        return replace(self, rows=made.drop("_value"))

    def running_max(self, value: Column, name: str) -> Scan:
        """`name`: the greatest value so far, this row's included."""
        return self._step(value, name, lambda w: F.max("_value").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), lambda: F.max("_value"), F.max, F.greatest)

    def running_sum(self, value: Column, name: str) -> Scan:
        """`name`: the sum so far, this row's included."""
        return self._step(value, name, lambda w: F.sum("_value").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)), lambda: F.sum("_value"), F.sum, lambda own, before: own + F.coalesce(before, F.lit(0)))

    def numbered(self, name: str) -> Scan:
        """`name`: the row's number within its key, from 0."""
        return self._step(F.lit(1), name, lambda w: F.row_number().over(w), lambda: F.count("_value"), F.sum, lambda own, before: (own - 1 + F.coalesce(before, F.lit(0))).cast("bigint"))

    def lagged(self, value: Column, name: str) -> Scan:
        """`name`: the value of the row before, null in a key's first."""
        last = lambda: F.max_by(F.struct("_value"), F.struct(*self.order))
        return self._step(value, name, lambda w: F.lag(F.struct("_value")).over(w), last, F.last, lambda own, before: F.coalesce(own, before)["_value"])

    def shifted(self, value: Column, by: int, name: str, default: Column) -> Scan:
        """`name`: the value `by` rows before, or the default. Where keys are dealt rows are numbered and meet by number, so neither side has a hot key."""
        if len(self.by) == 1:
            earlier = F.lag(F.struct(value.alias("v")), by).over(W.partitionBy(*self.by).orderBy(*self.order))
            made = self.rows.withColumn("_earlier", earlier)
        else:
            placed = self.numbered("_at").rows
            met = placed.select(F.col(self.key), (F.col("_at") + by).alias("_at"), F.struct(value.alias("v")).alias("_earlier"))
            made = placed.join(met, [self.key, "_at"], "left").drop("_at")
        return replace(self, rows=made.withColumn(name, F.when(F.col("_earlier").isNull(), default).otherwise(F.col("_earlier.v"))).drop("_earlier"))
