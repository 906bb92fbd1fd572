"""Running columns along a sequence, however long one sequence is.

A running column is what a state machine knows at a row: the last value a
flag let through, or how often a flag held. Over a stretch of rows both are
functions of the state before it, and such functions compose: ``last`` keeps
the later value, counts add up. So a long sequence is cut into stripes; every stripe is
scanned on its own, its effect on the state is one row, effects are composed
along the sequence (a row a stripe), and each stripe's rows take in the state it
began with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from folioquery.session import materialize


@dataclass(frozen=True)
class Last:
    """``value`` at the last row so far where ``flag`` holds; nulls do not count. ``before``: without the row itself."""

    flag: Column
    value: Column
    default: Column | None = None
    before: bool = False

    def local(self, window) -> Column:
        return F.last(F.when(self.flag, self.value), ignorenulls=True).over(window)

    def effect(self, order: str) -> Column:
        passed = F.when(self.flag, self.value)
        return F.max_by(passed, F.when(passed.isNotNull(), F.col(order)))

    def compose(self, effect: Column, window) -> Column:
        return F.last(effect, ignorenulls=True).over(window)

    def state(self, local: Column, carried: Column | None) -> Column:
        known = [local, *([] if carried is None else [carried]), *([] if self.default is None else [self.default])]
        return F.coalesce(*known)


@dataclass(frozen=True)
class Count:
    """How many rows so far have ``flag``."""

    flag: Column
    before: bool = False

    def local(self, window) -> Column:
        return F.count_if(self.flag).over(window)

    def effect(self, order: str) -> Column:
        return F.count_if(self.flag)

    def compose(self, effect: Column, window) -> Column:
        return F.sum(effect).over(window)

    def state(self, local: Column, carried: Column | None) -> Column:
        return F.coalesce(local, F.lit(0)) if carried is None else F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))


@dataclass(frozen=True)
class Sum:
    """The sum of ``value`` over the rows so far."""

    value: Column
    before: bool = False

    def local(self, window) -> Column:
        return F.sum(self.value).over(window)

    def effect(self, order: str) -> Column:
        return F.sum(self.value)

    def compose(self, effect: Column, window) -> Column:
        return F.sum(effect).over(window)

    def state(self, local: Column, carried: Column | None) -> Column:
        return F.coalesce(local, F.lit(0)) if carried is None else F.coalesce(local, F.lit(0)) + F.coalesce(carried, F.lit(0))


def running(rows: DataFrame, columns: dict[str, Last | Count | Sum], key: str, order: str, stripe: int | None = None) -> DataFrame:
    """``rows`` with running columns by ``order`` (unique numbers) within ``key``.

    Without ``stripe`` a sequence is one task's work. With it, stretches of that many
    order numbers are, and the rows are written once so both uses read the same.
    """
    def frame(spec, *keys):
        bound = -1 if spec.before else Window.currentRow
        return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, bound)

    if stripe is None:
        return rows.withColumns({name: spec.state(spec.local(frame(spec, key)), None) for name, spec in columns.items()})
    kept = materialize(rows.withColumn("_stripe", F.expr(f"`{order}` div {stripe}")), "striped")
    effects = kept.groupBy(key, "_stripe").agg(*[spec.effect(order).alias(name) for name, spec in columns.items()])
    earlier = Window.partitionBy(key).orderBy("_stripe").rowsBetween(Window.unboundedPreceding, -1)
    carried = effects.select(key, "_stripe", *[spec.compose(F.col(name), earlier).alias(f"_carried_{name}") for name, spec in columns.items()])
    local = kept.withColumns({name: spec.local(frame(spec, key, "_stripe")) for name, spec in columns.items()})
    return local.join(carried, [key, "_stripe"]).withColumns(
        {name: spec.state(F.col(name), F.col(f"_carried_{name}")) for name, spec in columns.items()}
    ).drop("_stripe", *[f"_carried_{name}" for name in columns])
