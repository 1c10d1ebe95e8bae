"""Keyed state over many batches: the same log as merging batch by batch, claims given once, replays, and cost that does not grow."""

import datetime
import json
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from noticelake.operators.upsert import Rules, merge
from noticelake.streaming import twins as S
from noticelake.workspace import stored

SCHEMA = "id long, source string, title string, deadline string, clock string, unsure boolean"
RULES = Rules("id", "source", ["source", "title", "deadline", "clock"], ["title", "deadline", "clock"], ["title"], (("unsure", ("deadline", "clock")),), (("deadline", "clock"),))


def batches(n, size, keys, seed=1):
    r = random.Random(seed)
    pick = lambda *x: r.choice(x)
    return [[(r.randrange(keys), pick("a", "b"), pick("x", "y", None, "é"), pick(None, "2026-01-01", "2026-02-01"), pick(None, "18:00"), pick(True, False, None, False)) for _ in range(size)] for _ in range(n)]


@pytest.fixture()
def folder(spark, tmp_path):
    def write(parts, schema=SCHEMA):
        for n, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{n:03}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    return write


def test_the_log_is_that_of_merging_batch_by_batch(spark, folder):
    parts = batches(4, 25, 12)
    ready, now = spark.createDataFrame([("a",)], "source string"), F.lit("2026-01-01").cast("timestamp_ntz")
    state, log = S.merge_stream(folder(parts), RULES, ready, now)
    columns = ["id", *RULES.columns]
    never = F.lit(None).cast("timestamp_ntz")
    old = spark.createDataFrame([], SCHEMA).select(*columns, *[never.alias(c) for c in ("first_seen", "last_seen", "last_changed")])
    want = []
    for rows in parts:
        merged = stored(merge(old, spark.createDataFrame(rows, SCHEMA), RULES, ready, now), "test-merge")
        want += [tuple(r[c] for c in (*columns, "change")) for r in merged.where("change is not null").collect()]
        old = merged.select(*columns, "first_seen", "last_seen", "last_changed")
    assert sorted([tuple(r[c] for c in (*columns, "change")) for r in log.collect()], key=repr) == sorted(want, key=repr)
    assert sorted([tuple(r[c] for c in columns) for r in state.collect()], key=repr) == sorted([tuple(r[c] for c in columns) for r in old.collect()], key=repr)


def test_claims_are_given_once_and_null_keys_too(spark, folder):
    parts = [[(1, 5), (1, -3), (None, 9)], [(1, 0), (2, 10), (2, 9)], [(None, 1), (3, None), (3, 4)]]
    found = S.claim_stream(folder(parts, "day long, run long"), "day", ["run"])
    assert sorted((tuple(r) for r in found.collect()), key=repr) == sorted([(1, -3), (None, 9), (2, 9), (3, None)], key=repr)


def test_a_batch_reads_only_its_own_keys(spark, folder, monkeypatch):
    """The rows that a batch updates in the state follow the batch, not what came before."""
    seen = []
    real = S.drained

    def watched(stream, label, mode="append"):
        out = real(stream, label, mode)
        seen.append(out.groupBy("batch").count().orderBy("batch").collect())
        return out

    monkeypatch.setattr(S, "drained", watched)
    parts = [[(1000 * n + i, "a", "t", None, None, None) for i in range(200 if n == 0 else 5)] for n in range(6)]
    S.merge_stream(folder(parts), RULES, spark.createDataFrame([("a",)], "source string"), F.lit("2026-01-01").cast("timestamp_ntz"))
    assert [r["count"] for r in seen[0]] == [200, 5, 5, 5, 5, 5]


class _Handle:
    """State of one bucket in memory, which counts the calls of its store."""

    def __init__(self):
        self.values, self.maps, self.calls = {}, {}, 0

    def getValueState(self, name, schema, ttl=None):
        return _Value(self)

    def getMapState(self, name, key, value, ttl=None):
        return _Map(self)


class _Value:
    def __init__(self, handle):
        self.handle = handle

    def exists(self):
        return "value" in self.handle.values

    def get(self):
        return self.handle.values.get("value")

    def update(self, value):
        self.handle.values["value"] = value


class _Map(_Value):
    def getValue(self, key):
        self.handle.calls += 1
        return self.handle.maps.get(key)

    def updateValue(self, key, value):
        self.handle.calls += 1
        self.handle.maps[key] = value


class _Now:
    def __init__(self, now=0):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now


def bucket_of(processor, rows, now=0):
    """What one call for a bucket gives for rows(key, title, at): (key, title, change, first seen, last changed)."""
    frame = pd.DataFrame([(f"={k}", json.dumps(t), json.dumps({"id": k, "title": t}), True, at) for k, t, at in rows], columns=["key", "rank", "row", "ready", "at"])
    found = [r for part in processor.handleInputRows((0,), iter([frame]), _Now(now)) for r in part.itertuples(index=False)]
    return sorted((r.key, json.loads(r.row).get("title"), r.change, r.first_seen, r.last_changed) for r in found)


def test_a_large_batch_takes_few_calls_of_the_store():
    processor, handle = S._Merges(Rules("id", "source", ["title"], ["title"]), None), _Handle()
    processor.init(handle)
    assert len(bucket_of(processor, [(k, "t", "1") for k in range(20_000)])) == 20_000
    assert handle.calls <= 2_000
    handle.calls = 0
    assert bucket_of(processor, [(7, "t", "2"), (8, "u", "2")]) == [("=7", "t", None, "1", "1"), ("=8", "u", "updated", "1", "2")]
    assert handle.calls == 4 and max(len(json.loads(page)) for (page,) in handle.maps.values()) < 4 * S.PAGE


def test_growing_buckets_are_dealt_anew(monkeypatch):
    monkeypatch.setattr(S, "PAGE", 2)
    r, processor, handle, known = random.Random(3), S._Merges(Rules("id", "source", ["title"], ["title"]), None), _Handle(), {}
    processor.init(handle)
    for at in "123456":
        rows = [(k, r.choice("xy"), at) for k in r.sample(range(60), 12)]
        want = []
        for k, title, _ in rows:
            old = known.get(k)
            change = "new" if old is None else "updated" if old[0] != title else None
            known[k] = title, old[1] if old else at, at if change else old[2]
            want.append((f"={k}", title, change, *known[k][1:]))
        assert bucket_of(processor, rows) == sorted(want)
    held = [name for (page,) in handle.maps.values() for name in json.loads(page)]
    assert sorted(held) == sorted(f"={k}" for k in known) and handle.values["value"][1] == len(known)


def test_idle_keys_are_new_again():
    processor, day = S._Merges(Rules("id", "source", ["title"], ["title"]), 2), 86_400_000
    processor.init(_Handle())
    assert [x[2] for x in bucket_of(processor, [(1, "t", "1"), (2, "t", "1")], 0)] == ["new", "new"]
    assert bucket_of(processor, [(1, "t", "2")], day) == [("=1", "t", None, "1", "1")]
    assert [x[2] for x in bucket_of(processor, [(1, "t", "3"), (2, "t", "3")], 2 * day)] == [None, "new"]


def test_keys_of_any_type_come_back(spark, folder):
    ready, now = spark.createDataFrame([("a",)], "source string"), F.lit("2026-01-01").cast("timestamp_ntz")
    keys = [datetime.datetime(2026, 1, 2, 3, 4, 5, 678901), None, datetime.datetime(1969, 1, 1)]
    schema = "id timestamp, source string, title string"
    _, log = S.merge_stream(folder([[(k, "a", "x") for k in keys], [(keys[0], "a", "x"), (None, "a", "y")]], schema), Rules("id", "source", ["title"], ["title"]), ready, now)
    found = sorted(((r["id"], r["title"], r["change"]) for r in log.collect()), key=repr)
    assert found == sorted([*((k, "x", "new") for k in keys), (None, "y", "updated")], key=repr)
