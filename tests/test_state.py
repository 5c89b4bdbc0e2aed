"""Stateful processors: the same result for any cut into micro-batches, and state that ends."""

import datetime as dt
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fixturelake.streaming import live, state

MS = 1000


class Store:
    """The handle of one key."""

    def __init__(self):
        self.lists, self.timers = defaultdict(list), set()

    def getListState(self, name, schema):
        store = self

        class One:
            def exists(self):
                return bool(store.lists[name])

            def get(self):
                return iter(list(store.lists[name]))

            def put(self, rows):
                store.lists[name] = list(rows)

            def clear(self):
                store.lists[name] = []

        return One()

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return iter(list(self.timers))


def play(make, rows, rng, late):
    """Output frames and the greatest and last state size; rows are (side, state row) and arrive late by less than ``late``."""
    store, out, most = Store(), [], 0
    processor = make()
    processor.init(store)
    arrival = sorted(rows, key=lambda r: r[1][0] + rng.randrange(late))
    watermark, seen, k = 0, 0, 0
    size = lambda: sum(map(len, store.lists.values()))
    while k < len(arrival):
        part = arrival[k : k + rng.randrange(1, 6)]
        k += len(part)
        out += processor.step(("k",), part, state._passed(watermark))
        seen = max(seen, *(r[1][0] for r in part))
        watermark = max(watermark, (seen - late) // MS)
        for due in sorted(t for t in store.timers if t < watermark):
            store.timers.discard(due)
            out += processor.step(("k",), [], state._passed(watermark))
        most = max(most, size())
    for _ in range(1000):
        if not store.timers:
            break
        due = min(store.timers)
        store.timers.discard(due)
        out += processor.step(("k",), [], state._passed(max(due, watermark)))
    return (pd.concat(out) if out else pd.DataFrame()), most, size()


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("forward", [False, True])
def test_as_of_join_of_any_cut(seed, forward):
    rng = random.Random(seed)
    within, late = 40 * MS, 30 * MS
    left = [(rng.randrange(1, 300) * MS + 50_000, "", f"l{k}") for k in range(60)]
    right = [(rng.randrange(1, 300) * MS + 50_000, str(k), f"r{k}") for k in range(40)]
    found, most, rest = play(lambda: state.AsOf(within, forward), [(0, r) for r in left] + [(1, r) for r in right], rng, late)
    want = {}
    for at, _, name in left:
        if forward:
            some = sorted(r for r in right if at <= r[0] <= at + within)
            want[name] = some[0][2] if some else None
        else:
            some = sorted(r for r in right if at - within <= r[0] <= at)
            want[name] = some[-1][2] if some else None
    assert len(found) == len(left)
    assert {a: b for a, b in zip(found["left"], found["right"], strict=True)} == want
    assert rest == 0 and most < 70


@pytest.mark.parametrize("seed", range(12))
def test_last_before_deadline_of_any_cut(seed):
    rng = random.Random(seed)
    rows = []
    for k in range(80):
        at = rng.randrange(1, 400) * MS + 50_000
        rows.append((at, f"{k:03}", at + rng.choice([0, 3, 10, 40]) * MS, f"u{k}"))
    found, most, rest = play(lambda: state.Last(False), [(0, r) for r in rows], rng, 30 * MS)
    ordered = sorted(rows)
    want = sorted(r[3] for r, after in zip(ordered, [*ordered[1:], None], strict=True) if after is None or after[0] > r[2])
    assert sorted(found["row"]) == want and found["final"].all()
    assert rest == 0 and most < 60


def hour(x):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=x)


def run(spark, stream, path, mode="append"):
    """Result rows so far and the last progress of the state operator."""
    rows = []
    with state.timers_allowed(spark):
        q = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", path).foreachBatch(lambda b, n: rows.extend(b.collect())).start()
        q.awaitTermination()
    return rows, q.lastProgress["stateOperators"][0]


def test_state_of_closed_matches_is_dropped(spark, tmp_path):
    schema = "match_id long, event_time timestamp, score int, status string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        updates = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        grace = F.when(F.col("status") == "FINISHED", F.expr("interval 1 hour")).otherwise(F.expr("interval 12 hours"))
        return state.last_before_deadline(updates, F.col("event_time") + grace)

    put([(m, hour(k), k, "FINISHED" if k == 2 else "LIVE") for m in range(20) for k in range(3)])
    rows, before = run(spark, stream(), str(tmp_path / "c"))
    assert rows == [] and before["numRowsTotal"] >= 20
    put([(99, hour(6), 0, "LIVE"), (3, hour(2), 7, "FINISHED")])
    rows, after = run(spark, stream(), str(tmp_path / "c"))
    assert sorted((r["match_id"], r["score"]) for r in rows) == [(m, 7 if m == 3 else 2) for m in range(20)]
    assert after["numRowsTotal"] < before["numRowsTotal"] / 4


def test_renewed_keys_do_not_expire(spark, tmp_path):
    schema = "key string, event_time timestamp, payload string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def stream():
        return state.last_before_deadline(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), F.col("event_time") + F.expr("interval 3 hours"), key="key", changes=True)

    put([("a", hour(0), "a0"), ("b", hour(0), "b0"), (None, hour(0), "n0")])
    rows, _ = run(spark, stream(), str(tmp_path / "c"), "update")
    assert sorted((r["payload"], r["final"]) for r in rows) == [("a0", False), ("b0", False), ("n0", False)]
    put([("a", hour(2), "a2"), ("c", hour(4.5), "c4")])
    rows, _ = run(spark, stream(), str(tmp_path / "c"), "update")
    # b expired at 3, with the watermark at 3.5; a was renewed.
    assert sorted((r["payload"], r["final"]) for r in rows) == [("a2", False), ("b0", True), ("c4", False), ("n0", True)]


def test_odds_and_settlements_over_several_steps(spark):
    predictions = [(1, hour(2), "HOME"), (1, hour(5), "AWAY"), (2, hour(3), "DRAW"), (3, hour(1), "HOME")]
    events = [(1, hour(1), None, 2.0), (1, hour(2), None, 2.5), (1, hour(4.9), None, 3.0), (2, hour(3.5), None, 9.0), (1, hour(6), "HOME", None), (1, hour(7), "AWAY", None), (3, hour(300), "HOME", None)]
    schema = "match_id long, event_time timestamp, outcome string, actual string, odds double"
    rows = spark.createDataFrame([(m, t, o, None, None) for m, t, o in predictions] + [(m, t, None, a, o) for m, t, a, o in events], schema)
    last = spark.createDataFrame([(-1, hour(9999), "end", None, None), (-1, hour(9999), None, "end", None), (-1, hour(9999), None, None, 1.0)], schema)
    asked = lambda s: s.where("outcome is not null").select("match_id", "event_time", "outcome")
    with state.timers_allowed(spark):
        odds = live.replay(rows, last, lambda s: state.odds_at_prediction(asked(s), s.where("odds is not null").select("match_id", "event_time", "odds")), "t-odds")
        assert sorted((r["match_id"], r["outcome"], r["quote"] and r["quote"]["odds"]) for r in odds.where("match_id > 0").collect()) == [
            (1, "AWAY", 3.0), (1, "HOME", 2.5), (2, "DRAW", None), (3, "HOME", None)]
        settled = live.replay(rows, last, lambda s: state.settled_once(asked(s), s.where("actual is not null").select("match_id", "event_time", "actual")), "t-settled")
    assert sorted((r["match_id"], r["outcome"], r["hit"]) for r in settled.where("match_id > 0").collect()) == [
        (1, "AWAY", False), (1, "HOME", True), (2, "DRAW", None), (3, "HOME", None)]


def test_keys_of_a_bucket_share_one_value_and_one_timer():
    """A thousand keys cost one write and one timer, come out each by its own rule, and leave no state."""
    calls = []

    class Value:
        row = None

        def exists(self):
            return self.row is not None

        def get(self):
            return self.row

        def update(self, row):
            calls.append("update")
            self.row = row

        def clear(self):
            self.row = None

    store, value = Store(), Value()
    store.getValueState = lambda name, schema: value
    bucket = state.Bucket(state.Last(False))
    bucket.init(store)
    out = list(bucket.step({f"k{k}": [(0, (k * MS, "", (k + 5) * MS, f"u{k}"))] for k in range(1000)}, 0))
    assert out == [] and calls == ["update"] and len(store.timers) == 1
    half = pd.concat(bucket.step({}, 504 * MS))
    assert sorted(half["row"]) == sorted(f"u{k}" for k in range(500)) and len(store.timers) == 1
    rest = pd.concat(bucket.step({None: [(0, (600 * MS, "", 600 * MS, "n"))]}, 10_000 * MS))
    assert len(rest) == 501 and value.row is None and not store.timers


def test_rows_travel_as_values_and_come_back(spark):
    """Names of columns are not repeated in each row, and values, nulls among them, are the same after the way through text."""
    import datetime as dt
    import decimal

    rows = [(1, "a\"b,]\n", 0.1 + 0.2, dt.datetime(1995, 1, 2, 3, 4, 5, 678901), dt.datetime(1960, 1, 1, 0, 0, 0, 1), dt.date(1900, 2, 3), True, decimal.Decimal("-1.50")), (None,) * 8, (-5, "", float("-inf"), None, None, None, False, None)]
    df = spark.createDataFrame(rows, "a_long_name long, s string, d double, t timestamp, n timestamp_ntz, day date, b boolean, m decimal(10,2)")
    text = df.select(state._row(df).alias("row"))
    assert all("a_long_name" not in r["row"] for r in text.collect())
    assert state._parsed(text, {"row": df}).select("row.*").collect() == df.collect()
    none = spark.createDataFrame([(None,)], "row string")
    assert state._parsed(none, {"row": df}).first()["row"] is None
    nested = df.select(F.struct("s", "d").alias("x"))
    assert state._parsed(nested.select(state._row(nested).alias("row")), {"row": nested}).select("row.*").where("x.s is not null").count() == 2


def test_a_bucket_is_compressed(spark):
    """Rows that wait in the state take a fraction of their bytes."""
    class Value:
        data = None
        exists = lambda self: self.data is not None
        get = lambda self: self.data
        update = lambda self, data: setattr(self, "data", data)

    class Handle:
        value = Value()
        getValueState = lambda self, name, schema: self.value  # noqa: E731, N815
        listTimers = lambda self: iter(())  # noqa: E731, N815
        registerTimer = deleteTimer = lambda self, at: None  # noqa: E731, N815

    bucket, rows = state.Bucket(state.AsOf(10)), 2000
    bucket.init(Handle())
    list(bucket.step({str(k): [(state.LEFT, (1_000_000 + k, "", f'["{k}","S{k % 6}","789000000000000","X"]'))] for k in range(rows)}, 0))
    assert bucket.value.data[0] == rows and len(bucket.value.data[1]) < 25 * rows
