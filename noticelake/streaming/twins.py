"""Structured Streaming twins of the stateful operators."""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.upsert import Rules
from ..workspace import own_folder

#: Spark's setting for the state store.
STORE = "spark.sql.streaming.stateStore.providerClass"
#: Buckets of keys for each shuffle partition of a merged stream, and how many keys are kept together at most, on average.
BUCKETS, PAGE = 16, 64
STAMPS = ["first_seen", "last_seen", "last_changed"]


def _work(spark: SparkSession, label: str) -> str:
    return f"{own_folder(spark)}/{label}-{uuid.uuid4().hex}"


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The files of one table as a stream; the schema is fixed by the table."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def drained(stream: DataFrame, label: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there, into a table of the shared folder, exactly once per batch."""
    spark = stream.sparkSession
    work = _work(spark, label)

    def sink(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{work}/out/batch={number}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{work}/state").foreachBatch(lambda b, n: sink(b.drop("batch"), n)).start().awaitTermination()
    return spark.read.schema(stream.schema.add("batch", T.IntegerType())).parquet(f"{work}/out")


def first_seen(events: DataFrame) -> DataFrame:
    """Stateful first sighting of each notice: one row of state a key, merged downstream by minimum."""
    return events.groupBy("notice").agg(F.min("seen_at").alias("first_seen"), F.count("*").alias("sightings"))


def latest(changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The last update of every key over all batches, which makes replays idempotent."""
    return changes.groupBy(key).agg(F.max_by(F.struct(*values), "batch").alias("last")).select(key, "last.*")


def late_flag(events: DataFrame, target_hour: int) -> DataFrame:
    """Late rows are flagged, not dropped, so no watermark is set."""
    return events.withColumn("late", F.hour("seen_at") >= target_hour)


def day_buckets(events: DataFrame, hours_ahead: int) -> DataFrame:
    """Calendar-day counts in a fixed local time."""
    local = F.timestamp_add("HOUR", F.lit(hours_ahead), F.col("seen_at"))
    return events.groupBy(local.cast("date").alias("day")).agg(F.count("*").alias("n"))


class _Kept:
    """Value state of a key: one JSON text, which goes when nothing of the key came for `idle_days` (never where that is None)."""

    def __init__(self, idle_days: int | None):
        self.ttl = None if idle_days is None else idle_days * 86_400_000

    def open(self, handle: StatefulProcessorHandle) -> None:
        self.value = handle.getValueState("kept", "json string", self.ttl)

    def get(self) -> dict | None:
        return json.loads(self.value.get()[0]) if self.value.exists() else None

    def put(self, value: dict) -> None:
        self.value.update((json.dumps(value, ensure_ascii=False),))


class _Claims(StatefulProcessor):
    """The first row of a key, once: the smallest by `rank` of the batch that first has the key."""

    def __init__(self, idle_days: int | None):
        self.kept = _Kept(idle_days)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.kept.open(handle)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        if self.kept.get() is not None:
            return
        best = min(((rank, row) for part in rows for rank, row in zip(part["rank"], part["row"])), default=None)
        if best is not None:
            self.kept.put({"claimed": True})
            yield pd.DataFrame({"row": [best[1]]})

    def close(self) -> None:
        pass


class _Merges(StatefulProcessor):
    """`operators.upsert.merge` for the keys of one bucket.

    The row of each key so far is kept with those of at most about `PAGE` other keys in an entry of a map, so that a call of the state store serves many keys of a large batch
    and a small batch reads and writes few others. The map is dealt anew into twice as many entries when they have grown too large.
    """

    def __init__(self, rules: Rules, idle_days: int | None):
        self.rules, self.idle = rules, None if idle_days is None else idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.size = handle.getValueState("size", "pages int, keys long", self.idle)
        self.pages = handle.getMapState("pages", "page int", "json string", self.idle)

    def handleInputRows(self, key, rows, timers) -> Iterator[pd.DataFrame]:
        last: dict[str, tuple] = {}
        for part in rows:
            for name, *found in zip(part["key"], part["rank"], part["row"], part["ready"].astype(bool), part["at"]):
                if name not in last or last[name] < found:
                    last[name] = found
        known = self.size.exists()
        count, keys = self.size.get() if known else (1, 0)
        while not known and PAGE * count < 2 * len(last):
            count *= 2
        now = timers.getCurrentProcessingTimeInMs() if self.idle is not None else 0
        turns: dict[int, list[str]] = {}
        for name in last:
            turns.setdefault(_page(name, count), []).append(name)
        out = []
        for page, names in turns.items():
            held = self._read(page) if known else {}
            before = len(held)
            if self.idle is not None:
                held = {name: entry for name, entry in held.items() if entry[2] + self.idle > now}
            for name in names:
                _, row, ready, at = last[name]
                held[name], line = self._entry(json.loads(row), held.get(name), ready, at, now)
                out.append((name, *line))
            self._write(page, held)
            keys += len(held) - before
        if keys > PAGE * count and self.idle is not None:  # whole entries may have gone since they were counted
            keys = sum(len(self._read(page)) for page in range(count))
        while keys > PAGE * count:
            for page in range(count):
                if held := self._read(page):
                    for half in (page, page + count):
                        self._write(half, {name: entry for name, entry in held.items() if _page(name, 2 * count) == half})
            count *= 2
        self.size.update((count, keys))
        if out:
            yield pd.DataFrame(out, columns=["key", "row", "change", *STAMPS], dtype=object)

    def _read(self, page: int) -> dict:
        found = self.pages.getValue((page,))
        return {} if found is None else json.loads(found[0])

    def _write(self, page: int, held: dict) -> None:
        self.pages.updateValue((page,), (json.dumps(held, ensure_ascii=False),))

    def _entry(self, new: dict, old: list | None, ready: bool, at: str, now: int) -> tuple[list, tuple]:
        """(row, stamps, time) of a key as they are kept, and what the batch tells of it."""
        merged = self._merged(new, old[0] if old else {})
        if old is None:
            change, stamps = "new" if ready else "initial", [at, at, at]
        else:
            changed = any(merged.get(c) != old[0].get(c) for c in self.rules.tracked)
            change, stamps = "updated" if changed else None, [old[1][0], at, at if changed else old[1][2]]
        return [merged, stamps, now], (json.dumps(merged, ensure_ascii=False), change, *stamps)

    def _merged(self, new: dict, old: dict) -> dict:
        out = {c: new[c] if new.get(c) is not None else old.get(c) for c in self.rules.columns}
        for date, clock in self.rules.clocks:
            if new.get(date) is not None and new[date] != old.get(date):
                out[clock] = new.get(clock)
        for flag, names in self.rules.cleared:
            if new.get(flag):
                out.update(dict.fromkeys((n for n in names if n in out)))
        return {c: v for c, v in out.items() if v is not None}

    def close(self) -> None:
        pass


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Arbitrary keyed state needs the state store that keeps changes on disk; the session's own choice comes back afterwards."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)


def _page(name: str, count: int) -> int:
    return zlib.crc32(name.encode()) % count


def _ranked(stream: DataFrame, order: list[str]) -> Column:
    """A text that sorts as the columns do: whole numbers shifted above zero and padded, other values (fractions, too) by their text, nulls first."""
    kinds = {f.name: f.dataType for f in stream.schema.fields}

    def sortable(name: str) -> Column:
        if isinstance(kinds[name], T.IntegralType):
            shifted = F.col(name).cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")
            return F.lpad(shifted.cast("string"), 20, "0")
        return F.col(name).cast("string")

    return F.concat(*[F.coalesce(F.concat(F.lit("\u0002"), sortable(c)), F.lit("\u0001")) for c in order])


def claim_stream(stream: DataFrame, key: str, order: list[str], idle_days: int | None = None) -> DataFrame:
    """Claims (key, the other columns) of a stream, each key given once over all batches: the first of its first batch by `order`.

    That a key was claimed is state of the key, so a batch costs its own rows however many came before; a replayed batch finds the state before it and gives
    the same claims. With `idle_days` a claim is forgotten after so many days. Keys that are null claim once, too.
    """
    rest = [c for c in stream.columns if c != key]
    packed = stream.select(F.col(key), _ranked(stream, [*order, *[c for c in rest if c not in order]]).alias("rank"), F.to_json(F.struct(*stream.columns)).alias("row"))
    with _keyed_state(stream.sparkSession):
        found = drained(packed.groupBy(key).transformWithStateInPandas(_Claims(idle_days), "row string", "Append", "processingTime" if idle_days else "none"), "claims")
    return found.select(F.from_json("row", stream.schema).alias("r")).select("r.*")


def merge_stream(stream: DataFrame, rules: Rules, initialised: DataFrame, at: Column, idle_days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(state, log of changes) of a stream of batches merged by the rules of `merge`.

    The rows of the keys are keyed state: a batch reads and writes the keys that it has, with a bounded number of others that are kept beside each, never the whole state, and
    a replay starts from the state before it. State belongs to buckets of keys, so that a task is called once a bucket and not once a key. Every batch gives
    the rows that it merged; `state` is the last one of each key. With `idle_days` a key that was not seen for so many days is forgotten and new again.
    """
    rank = _ranked(stream, [*rules.order, *[c for c in stream.columns if c != rules.key and c not in rules.order]])
    ready = initialised.select(F.col(initialised.columns[0]).alias(rules.source), F.lit(True).alias("ready")).distinct()
    spelled, read_back = _spelling(stream.schema[rules.key])
    buckets = BUCKETS * int(stream.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = stream.join(ready, rules.source, "left").select(
        F.pmod(F.xxhash64(rules.key), F.lit(buckets)).alias("bucket"), F.coalesce(F.concat(F.lit("="), spelled), F.lit("")).alias("key"), rank.alias("rank"), F.to_json(F.struct(*stream.columns)).alias("row"),
        F.coalesce("ready", F.lit(False)).alias("ready"), at.cast("string").alias("at"),
    )
    out = "key string, row string, change string, " + ", ".join(f"{x} string" for x in STAMPS)
    with _keyed_state(stream.sparkSession):
        merged = drained(packed.groupBy("bucket").transformWithStateInPandas(_Merges(rules, idle_days), out, "Append", "processingTime" if idle_days else "none"), "merged")
    read = T.StructType([f for f in stream.schema.fields if f.name in rules.columns and f.name != rules.key])
    key = F.when(F.col("key") != "", read_back(F.substr("key", F.lit(2)))).alias(rules.key)
    rows = merged.select("batch", key, F.from_json("row", read).alias("r"), "change", *[F.col(c).cast("timestamp_ntz").alias(c) for c in STAMPS]).select("batch", rules.key, "r.*", "change", *STAMPS)
    state = latest(rows.drop("change"), rules.key, [*[f.name for f in read.fields], *STAMPS])
    return state, rows.where("change is not null").drop("batch")


def _spelling(field: T.StructField) -> tuple[Column, Callable[[Column], Column]]:
    """A key as text, and how the text is read back, without loss."""
    kind, value = field.dataType, F.col(field.name)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value).cast("string"), lambda x: F.timestamp_micros(x.cast("long"))
    if isinstance(kind, T.BinaryType):
        return F.hex(value), F.unhex
    if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(value), lambda x: F.from_json(x, kind)
    return value.cast("string"), lambda x: x.cast(kind)


def within(events: DataFrame, key: str, at: str, days: int) -> DataFrame:
    """The first row of each key; the state of a key expires when no row of it came for so many days."""
    return events.withWatermark(at, f"{days} days").dropDuplicatesWithinWatermark([key])
