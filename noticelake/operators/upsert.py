"""Upsert of a batch into a keyed state, with a change log."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    """How columns of a batch and of the state meet.

    `key` names a row and `source` where it comes from. Of the others, `columns` are taken from the batch where it has a value and kept else.
    `cleared` names, for a flag of the batch, the columns that it empties. `clocks` names, for a date, its clock: a new date brings its own clock, or none.
    A row is updated where a column of `tracked` differs. `order` decides which of several batch rows of a key counts: the last.
    """

    key: str
    source: str
    columns: Sequence[str]
    tracked: Sequence[str]
    order: Sequence[str] = ()
    cleared: tuple[tuple[str, Sequence[str]], ...] = ()
    clocks: tuple[tuple[str, str], ...] = ()


def _last(batch: DataFrame, rules: Rules) -> DataFrame:
    """One row a key: the last in order."""
    rest = [c for c in batch.columns if c != rules.key]
    order = F.struct(*[F.col(c) for c in (*rules.order, *rest)])
    return batch.groupBy(rules.key).agg(F.max_by(F.struct(*rest), order).alias("row")).select(rules.key, "row.*")


def _merged(rules: Rules, name: str) -> Column:
    """The value of a column after the batch: given, else kept, unless a flag or a new date empties it."""
    value = F.coalesce(f"new_{name}", f"old_{name}")
    for date, clock in rules.clocks:
        if clock == name:
            value = F.when(F.col(f"new_{date}").isNotNull() & ~F.col(f"new_{date}").eqNullSafe(F.col(f"old_{date}")), F.col(f"new_{clock}")).otherwise(value)
    for flag, names in rules.cleared:
        if name in names:
            value = F.when(~F.coalesce(F.col(f"new_{flag}"), F.lit(False)), value)
    return value


def merge(state: DataFrame, batch: DataFrame, rules: Rules, initialised: DataFrame, at: Column) -> DataFrame:
    """The state after the batch, one row a key: key, columns, first_seen, last_seen, last_changed and `change`.

    state(key, columns, first_seen, last_seen, last_changed); batch(key, columns, flags). `change` is new, initial, updated or null, with the dates of
    `clocks` before and after in old_<date> and new_<date>. An unseen row is new only where its source is in `initialised`. One shuffle on the key.
    """
    stamps = ["first_seen", "last_seen", "last_changed"]
    flags = [flag for flag, _ in rules.cleared if flag not in rules.columns]
    old = state.select(rules.key, *[F.col(c).alias(f"old_{c}") for c in (*rules.columns, *stamps)], F.lit(True).alias("known"))
    new = _last(batch, rules).select(rules.key, *[F.col(c).alias(f"new_{c}") for c in (*rules.columns, *flags)], F.lit(True).alias("seen"))
    seen, known = F.col("seen").isNotNull(), F.col("known").isNotNull()
    both = old.join(new, rules.key, "full_outer").select("*", *[F.when(seen, _merged(rules, c)).otherwise(F.col(f"old_{c}")).alias(c) for c in rules.columns])
    ready = initialised.select(F.col(rules.source).alias("ready_source")).distinct()
    both = both.join(ready, F.col(rules.source) == F.col("ready_source"), "left")
    differs = F.lit(False)
    for c in rules.tracked:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"old_{c}"))
    change = F.when(~seen, None).when(~known, F.when(F.col("ready_source").isNotNull(), "new").otherwise("initial")).when(differs, "updated")
    both = both.withColumn("change", change)
    dates = [c for pair in rules.clocks for c in pair]
    return both.select(
        rules.key, *rules.columns,
        F.coalesce("old_first_seen", at).alias("first_seen"), F.when(seen, at).otherwise(F.col("old_last_seen")).alias("last_seen"),
        F.when(F.col("change").isNotNull(), at).otherwise(F.col("old_last_changed")).alias("last_changed"), "change",
        *[F.when(F.col("change") == "updated", F.col(f"old_{c}")).alias(f"old_{c}") for c in dates],
        *[F.when(F.col("change") == "updated", F.col(c)).alias(f"new_{c}") for c in dates],
    )


def upsert(state: DataFrame, batch: DataFrame, key: str, columns: Sequence[str], tracked: Sequence[str], initialised: DataFrame, source: str) -> DataFrame:
    """State after the batch, with `change`: new, initial, updated or null; one row a key, however often the batch has it."""
    never = F.lit(None).cast("timestamp_ntz")
    dated = state.select(key, *columns, *[never.alias(c) for c in ("first_seen", "last_seen", "last_changed")])
    return merge(dated, batch, Rules(key, source, columns, tracked), initialised, never).select(key, *columns, "change")


def trimmed(changes: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """The rows of a log that are at most so many days old."""
    return changes.where(F.col(at) >= F.timestamp_add("DAY", F.lit(-days), now))


def claimed(claims: DataFrame, wanted: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The rows of `wanted` that get their key: the first in order of each key that is not in `claims` yet. Appended to `claims`, a key is given once."""
    free = wanted.join(claims.select(key).distinct(), key, "left_anti")
    rest = [c for c in wanted.columns if c != key]
    return free.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in (*order, *rest)])).alias("row")).select(key, "row.*")
