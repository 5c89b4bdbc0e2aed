"""Streaming joins and states with an end, as stateful processors with event-time timers.

All of them work in event time: a decision is made when the watermark has passed
the time after which no row can change it, so the result doesn't depend on how
rows are cut into micro-batches, and rows are dropped from the state as soon as
nothing can need them. Keys are dealt to ``BUCKETS`` buckets by their hash, and the
keys of a bucket share one state value in RocksDB and one timer, so that a batch
costs a few calls to the state store per bucket, not per key. A key's life bounds
its part of the value, and a bucket without keys has no value.

Rows travel through the state as JSON arrays of their values next to their times
in microseconds, so the processors don't depend on the columns of their inputs,
and state values are compressed: a step's rows wait in the state until the
watermark passes them, so their bytes are what the disk must hold. A row that is
later than the watermark is dropped by the engine and counted in its metrics.
"""

from __future__ import annotations

import pickle
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from contextlib import contextmanager
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

LATE = "1 hour"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_RETAINED = "spark.sql.streaming.minBatchesToRetain"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_JSON = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"}
_PLAIN = {"byte", "short", "integer", "long", "float", "double", "boolean", "string", "date", "timestamp", "timestamp_ntz"}
LEFT, RIGHT = 0, 1
#: Number of state values; a checkpoint belongs to one number.
BUCKETS = 4096


@contextmanager
def timers_allowed(spark: SparkSession) -> Iterator[None]:
    """The state store that timers need, for queries that start inside; of its old versions two batches' are kept."""
    wanted = {_PROVIDER: _ROCKSDB, _RETAINED: "2"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v else spark.conf.unset(k)


def micros(length: str) -> int:
    """An interval such as '7 days' in microseconds."""
    import pandas as pd

    return int(pd.Timedelta(length).value // 1000)


def _timer(at: int) -> int:
    """The first whole millisecond after a time in microseconds: a watermark there lets no row of that time through."""
    return at // 1000 + 1


def _passed(watermark_ms: int) -> int:
    """The last time in microseconds of which all rows are there."""
    return watermark_ms * 1000 - 1


class _Processor(StatefulProcessor):
    """Lists of (at, tie, json and more) in the state, one timer for the next decision; ``decide`` is the rule of one key."""

    fields = ("at", "tie", "row")
    lists: tuple[str, ...] = ()
    output: tuple[str, ...] = ()

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        schema = ", ".join(f"{c} {'string' if c in ('tie', 'row') else 'long'}" for c in self.fields)
        self.state = {name: handle.getListState(name, schema) for name in self.lists}

    def close(self) -> None:
        pass

    def read(self, name: str) -> list[tuple]:
        state = self.state[name]
        return sorted(map(tuple, state.get())) if state.exists() else []

    def write(self, name: str, rows: list[tuple]) -> None:
        if rows:
            self.state[name].put(rows)
        else:
            self.state[name].clear()

    def set_timer(self, at: int | None) -> None:
        """Only the timer of the next decision stays."""
        known = set(self.handle.listTimers())
        wanted = set() if at is None else {_timer(at)}
        for t in known - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - known:
            self.handle.registerTimer(t)

    def arrived(self, rows: Iterator[pd.DataFrame]) -> list[tuple[int, tuple]]:
        """(side, state row) of the rows of a batch."""
        out = []
        for frame in rows:
            out += [(s, tuple(r)) for s, *r in zip(frame["side"].tolist(), *[frame[c].tolist() for c in self.fields], strict=True)]
        return out

    def handleInputRows(self, key, rows, timerValues):
        yield from self.step(key, self.arrived(rows), _passed(timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.step(key, [], _passed(timerValues.getCurrentWatermarkInMs()))

    def step(self, key: tuple, new: list[tuple[int, tuple]], passed: int) -> Iterator[pd.DataFrame]:
        import pandas as pd

        kept, due, out = self.decide([self.read(name) for name in self.lists], new, passed)
        for name, rows in zip(self.lists, kept, strict=True):
            self.write(name, rows)
        self.set_timer(due)
        if out:
            yield pd.DataFrame([(str(key[0]), *r) for r in out], columns=["key", *self.output])

    def decide(self, lists: list[list[tuple]], new: list[tuple[int, tuple]], passed: int) -> tuple[list[list[tuple]], int | None, list[tuple]]:
        """(lists to keep, time of the next decision, output rows) of one key, by its sorted lists and new (side, row)."""
        raise NotImplementedError


class AsOf(_Processor):
    """Each left row with the newest right row of its key at or before it, at most ``within`` back."""

    lists = ("left", "right")
    output = ("left", "right")

    def __init__(self, within: int, forward: bool = False):
        self.within, self.forward = within, forward

    def decide(self, lists, new, passed):
        left = sorted(lists[0] + [r for side, r in new if side == LEFT])
        right = sorted(lists[1] + [r for side, r in new if side == RIGHT])
        times = [r[0] for r in right]
        found, wait, due = [], [], []
        for row in left:
            best, until = self.partner(row[0], right, times)
            if until <= passed:
                found.append((row[2], None if best is None else best[2]))
            else:
                wait.append(row)
                due.append(until)
        # What rows that wait, or that may still arrive, can need.
        first = min(passed + 1, wait[0][0]) if wait else passed + 1
        if self.forward:
            right = right[bisect_left(times, first) :]
        else:
            k = bisect_right(times, first)
            right = ([right[k - 1]] if k and times[k - 1] >= passed - self.within else []) + right[k:]
            if right and not due:
                due.append(right[-1][0] + self.within)
        return [wait, right], (min(due) if due else (right[-1][0] if right else None)), found

    def partner(self, at: int, right: list[tuple], times: list[int]) -> tuple[tuple | None, int]:
        """(right row, time after which it can't change); times: those of right, in order."""
        if self.forward:
            k = bisect_left(times, at)
            return (right[k], times[k]) if k < len(right) and times[k] <= at + self.within else (None, at + self.within)
        k = bisect_right(times, at)
        return (right[k - 1] if k and times[k - 1] >= at - self.within else None), at


class Last(_Processor):
    """The rows of a key that no other row follows until their deadline; with ``changes`` also each newest row as it comes."""

    fields = ("at", "tie", "deadline", "row")
    lists = ("rows",)
    output = ("row", "final")

    def __init__(self, changes: bool):
        self.changes = changes

    def decide(self, lists, new, passed):
        before = lists[0]
        rows = sorted(before + [r for _, r in new])
        out = []
        if self.changes and new and (not before or rows[-1] != before[-1]):
            out.append((rows[-1][3], False))
        # A row that is followed in time never comes out; it stays while a row before it may still arrive.
        until = [r[0] if after is not None and after[0] <= r[2] else max(r[0], r[2]) for r, after in zip(rows, [*rows[1:], None], strict=True)]
        out += [(r[3], True) for r, after, u in zip(rows, [*rows[1:], None], until, strict=True) if u <= passed and (after is None or after[0] > r[2])]
        return [[r for r, u in zip(rows, until, strict=True) if u > passed]], min((u for u in until if u > passed), default=None), out


class Bucket(StatefulProcessor):
    """The keys of a bucket, each by the rule of a processor: {key: (lists, time of its next decision)} in one state value."""

    def __init__(self, rule: _Processor):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.value = handle, handle.getValueState("keys", "number long, data binary")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        new: dict[str | None, list] = {}
        for frame in rows:
            for k, side, *r in zip(frame["state_key"].tolist(), frame["side"].tolist(), *[frame[c].tolist() for c in self.rule.fields], strict=True):
                new.setdefault(k, []).append((side, tuple(r)))
        yield from self.step(new, _passed(timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.step({}, _passed(timerValues.getCurrentWatermarkInMs()))

    def step(self, new: dict[str | None, list], passed: int) -> Iterator[pd.DataFrame]:
        import pandas as pd

        known = pickle.loads(zlib.decompress(self.value.get()[1])) if self.value.exists() else {}  # our own state
        none = ([[] for _ in self.rule.lists], None)
        out = []
        for k in [*new, *[k for k, (_, due) in known.items() if due is not None and due <= passed and k not in new]]:
            kept, due, found = self.rule.decide(known.get(k, none)[0], new.get(k, []), passed)
            out += [(str(k), *r) for r in found]
            if any(kept):
                known[k] = (kept, due)
            else:
                known.pop(k, None)
        if known:
            self.value.update((len(known), zlib.compress(pickle.dumps(known, protocol=5), 1)))
        elif self.value.exists():
            self.value.clear()
        due = min((due for _, due in known.values() if due is not None), default=None)
        timers = set(self.handle.listTimers())
        wanted = set() if due is None else {_timer(due)}
        for t in timers - wanted:
            self.handle.deleteTimer(t)
        for t in wanted - timers:
            self.handle.registerTimer(t)
        if out:
            yield pd.DataFrame(out, columns=["key", *self.rule.output])


def _is_plain(df: DataFrame) -> bool:
    """All columns have types whose values are the same after a cast to text and back."""
    return all(f.dataType.typeName() in _PLAIN or f.dataType.typeName().startswith("decimal") for f in df.schema)


def _row(df: DataFrame) -> Column:
    """A row as text: an array of its values, without the names, where all of them are plain."""
    if not _is_plain(df):
        return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), _JSON)
    moment = lambda f: F.unix_micros(f"`{f.name}`") if f.dataType.typeName() == "timestamp" else F.col(f"`{f.name}`")
    return F.to_json(F.array(*[moment(f).cast("string") for f in df.schema]))


def _parsed(out: DataFrame, rows: dict[str, DataFrame]) -> DataFrame:
    """Columns of rows as text to structs; rows: the table that each comes from. No text gives no row."""
    text = {c: F.from_json(c, "array<string>") if _is_plain(df) else F.from_json(c, df.schema, _JSON) for c, df in rows.items()}
    first = out.withColumns(text)

    def value(column: str, number: int, f) -> Column:
        one = F.get(column, F.lit(number))
        return (F.timestamp_micros(one.cast("long")) if f.dataType.typeName() == "timestamp" else one.cast(f.dataType)).alias(f.name)

    structs = {c: F.when(F.col(c).isNotNull(), F.struct(*[value(c, k, f) for k, f in enumerate(df.schema)])) for c, df in rows.items() if _is_plain(df)}
    return first.withColumns(structs)


def _placed(key: str) -> list[Column]:
    return [F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("state_bucket"), F.col(key).cast("string").alias("state_key")]


def _side(df: DataFrame, carried: DataFrame, side: int, key: str, tie: Column | None, late: str) -> DataFrame:
    tied = F.lit("") if tie is None else F.coalesce(tie, F.lit(""))
    marked = df.withWatermark("event_time", late)
    return marked.select(*_placed(key), "event_time", F.lit(side).alias("side"), F.unix_micros("event_time").alias("at"), tied.alias("tie"), _row(carried).alias("row"))


def _joined(left: DataFrame, right: DataFrame, processor: AsOf, key: str, tie: Column | None, late: str, columns: list[str] | None = None) -> DataFrame:
    """l and r, the rows of both sides; columns: those of the right side that are asked for, else all."""
    carried = right if columns is None else right.select(*[f"`{c}`" for c in columns])
    both = _side(left, left, LEFT, key, None, late).unionByName(_side(right, carried, RIGHT, key, tie, late))
    out = both.groupBy("state_bucket").transformWithStateInPandas(Bucket(processor), "key string, left string, right string", "append", "eventTime")
    return _parsed(out, {"left": left, "right": carried}).select(F.col("left").alias("l"), F.col("right").alias("r"))


def odds_at_prediction(predictions: DataFrame, quotes: DataFrame, within: str = "60 days", late: str = LATE, tie: Column | None = None, columns: list[str] | None = None) -> DataFrame:
    """Stream of predictions (match_id, event_time, ...) with the quote that held then, as the column quote; null if there is none.

    The newest quote of the match at or before the prediction counts, if it isn't older than ``within``, which bounds how
    long the last quote of a match is kept. Of quotes of one time the one whose tie, a text, is greatest counts. Of a quote
    only some columns are kept and come out, if given.
    """
    out = _joined(predictions, quotes, AsOf(micros(within)), "match_id", tie, late, columns)
    return out.select("l.*", F.col("r").alias("quote"))


def settled_once(predictions: DataFrame, finals: DataFrame, within: str = "7 days", late: str = LATE, tie: Column | None = None) -> DataFrame:
    """Stream of all predictions (match_id, event_time, outcome, ...), each once, with settled_at, actual and hit.

    The earliest finish event (match_id, event_time, actual) at or after a prediction settles it; a prediction without one
    ``within`` that time comes out as pending, with nulls, when the watermark shows that none can come.
    """
    out = _joined(predictions, finals, AsOf(micros(within), forward=True), "match_id", tie, late)
    return out.select("l.*", F.col("r.event_time").alias("settled_at"), F.col("r.actual").alias("actual"), (F.col("l.outcome") == F.col("r.actual")).alias("hit"))


def last_before_deadline(updates: DataFrame, deadline: Column, key: str = "match_id", changes: bool = False, late: str = LATE, tie: Column | None = None) -> DataFrame:
    """Stream of updates (key, event_time, ...) that no other one follows until their deadline, with final = true.

    The deadline may be a kickoff, a grace after a finish, or the update's time and a time to live. When the watermark
    has passed it, the row comes out once and the key's state is gone. ``changes`` adds each batch's newest row of a key.
    """
    marked = updates.withColumn("_deadline", F.unix_micros(deadline))
    tied = F.lit("") if tie is None else F.coalesce(tie, F.lit(""))
    rows = marked.withWatermark("event_time", late).select(
        *_placed(key), "event_time", F.lit(LEFT).alias("side"), F.unix_micros("event_time").alias("at"), tied.alias("tie"), F.col("_deadline").alias("deadline"), _row(updates).alias("row")
    )
    mode = "update" if changes else "append"
    out = rows.groupBy("state_bucket").transformWithStateInPandas(Bucket(Last(changes)), "key string, row string, final boolean", mode, "eventTime")
    return _parsed(out, {"row": updates}).select(F.col("row").alias("u"), "final").select("u.*", "final")
