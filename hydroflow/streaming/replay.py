"""Keyed state over daily rows that arrive in any order.

A series keeps its last days with the state after each of them, and the state from before the first kept day. A day
that comes in order is one step from the newest state. A late day is put in its place and the series is replayed from
there; days whose result changes are emitted again with a higher version. A day older than all kept ones cannot be
placed any more: it is emitted as late, with its values, so that it can be counted and given to a batch job.

Output: keys, date, the day's inputs, its results, version (rising per key) and late.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from hydroflow import config as C
from hydroflow.session import ROCKSDB_PROVIDER

#: Days of a series that can still be corrected.
KEEP_DAYS = 400


@dataclass(frozen=True)
class Recurrence:
    """One step of a state along the days of a series.

    ``step(state, inputs)`` gives the next state, whose values are the day's results; ``shown(state)`` says
    whether a result is emitted. A result that was emitted and is not shown any more is emitted with nulls.
    """

    inputs: tuple[str, ...]
    results: tuple[tuple[str, T.DataType], ...]
    start: tuple
    step: Callable[[tuple, tuple], tuple]
    shown: Callable[[tuple], bool]


def stuck_sensor(min_run: int = C.PERSISTENCE_RUN) -> Recurrence:
    """Days from the ``min_run``-th identical consecutive value on."""
    def step(state: tuple, inputs: tuple) -> tuple:
        (value,), (last, length) = inputs, state
        return value, 0 if value is None else length + 1 if value == last else 1

    return Recurrence(("value",), (("run_value", T.DoubleType()), ("run_length", T.IntegerType())), (None, 0), step,
                      lambda state: state[1] >= min_run)


def catchment(decay: float = C.API_DECAY, s_max: float = C.BUCKET_S_MAX) -> Recurrence:
    """Antecedent index and soil bucket; a missing value counts as none, as in the batch operator."""
    def step(state: tuple, inputs: tuple) -> tuple:
        rain, et = (0.0 if v is None else v for v in inputs)
        level = state[1] + rain - et
        return decay * state[0] + rain, min(max(level, 0.0), s_max), max(level - s_max, 0.0)

    results = tuple((c, T.DoubleType()) for c in ("api", "bucket_S", "bucket_Q"))
    return Recurrence(("rain", "et"), results, (0.0, s_max / 2, 0.0), step, lambda state: True)


class Replay(StatefulProcessor):
    """Runs a recurrence over each key's days and corrects what late days change."""

    def __init__(self, keys: Sequence[str], rule: Recurrence, keep_days: int = KEEP_DAYS):
        self.keys, self.rule, self.keep = list(keys), rule, keep_days
        self.width = len(rule.inputs)

    def init(self, handle: StatefulProcessorHandle) -> None:
        results = [T.StructField(n, t) for n, t in self.rule.results]
        inputs = [T.StructField(n, T.DoubleType()) for n in self.rule.inputs]
        date = T.StructField("date", T.DateType())
        #: newest day, its state, number of kept days, version
        self.tip = handle.getValueState("tip", T.StructType([date, *results, T.StructField("kept", T.IntegerType()),
                                                             T.StructField("version", T.LongType())]))
        #: last day that is not kept any more, and its state
        self.base = handle.getValueState("base", T.StructType([date, *results]))
        self.days = handle.getListState("days", T.StructType([date, *inputs, *results]))

    def _new_days(self, rows: Iterator[pd.DataFrame]) -> list[tuple]:
        """Days of a batch in order; of several rows of a day the one with the largest values."""
        names = ["date", *self.rule.inputs]
        frame = pd.concat(rows, ignore_index=True)[names].sort_values(names, na_position="first").drop_duplicates("date", keep="last")
        return [(d, *(None if pd.isna(v) else float(v) for v in values)) for d, *values in frame.itertuples(index=False)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = self._new_days(rows)
        tip = self.tip.get() if self.tip.exists() else None
        version = tip[-1] + 1 if tip else 1
        if tip is None or new[0][0] > tip[0]:
            out = self._go_on(new, tip, version)
        else:
            out = self._replay(new, tip, version)
        names = ["date", *self.rule.inputs, *[n for n, _ in self.rule.results], "version", "late"]
        frame = pd.DataFrame(out, columns=names)
        for name, part in zip(reversed(self.keys), reversed(key)):
            frame.insert(0, name, part)
        yield frame

    def _go_on(self, new: list[tuple], tip: tuple | None, version: int) -> list[tuple]:
        state, kept = (tuple(tip[1:-2]), tip[-2]) if tip else (self.rule.start, 0)
        entries = []
        for day in new:
            state = self.rule.step(state, day[1:])
            entries.append((*day, *state))
        self.days.appendList(entries)
        kept += len(entries)
        self.tip.update((new[-1][0], *state, kept, version))
        if kept > 2 * self.keep:
            self._trim([tuple(e) for e in self.days.get()], version)
        return [(*e, version, False) for e in entries if self.rule.shown(self._state(e))]

    def _state(self, entry: tuple) -> tuple:
        return tuple(entry[1 + self.width:])

    def _replay(self, new: list[tuple], tip: tuple, version: int) -> list[tuple]:
        base = self.base.get() if self.base.exists() else None
        nothing = (None,) * len(self.rule.results)
        out = [(*day, *nothing, version, True) for day in new if base and day[0] <= base[0]]
        new = {day[0]: day for day in new if not base or day[0] > base[0]}
        before = {e[0]: tuple(e) for e in self.days.get()}
        changed = {d for d, day in new.items() if d not in before or before[d][:1 + self.width] != day}
        if not changed:
            return out
        first, last = min(changed), max(changed)
        entries, state, settled = [], tuple(base[1:]) if base else self.rule.start, False
        for date in sorted({*before, *new}):
            old = before.get(date)
            if date < first or settled:
                entries.append(old)
                state = self._state(old)
                continue
            inputs = new[date][1:] if date in new else old[1:1 + self.width]
            state = self.rule.step(state, inputs)
            entries.append((date, *inputs, *state))
            settled = date >= last and old is not None and self._state(old) == state
            if old != entries[-1]:
                if self.rule.shown(state):
                    out.append((*entries[-1], version, False))
                elif old is not None and self.rule.shown(self._state(old)):
                    out.append((date, *inputs, *nothing, version, False))
        self._trim(entries, version)
        return out

    def _trim(self, entries: list[tuple], version: int) -> None:
        """Keep the last days; the state before them goes to the base."""
        cut = max(0, len(entries) - self.keep) if len(entries) > 2 * self.keep else 0
        if cut:
            self.base.update((entries[cut - 1][0], *self._state(entries[cut - 1])))
        self.days.put(entries[cut:])
        self.tip.update((entries[-1][0], *self._state(entries[-1]), len(entries) - cut, version))

    def close(self) -> None:
        pass


def replayed(days: DataFrame, keys: Sequence[str], rule: Recurrence, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Run a recurrence over a stream of daily rows; at least ``keep_days`` and at most twice as many can be corrected."""
    days.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    fields = [T.StructField(k, days.schema[k].dataType) for k in keys] + [T.StructField("date", T.DateType())]
    fields += [T.StructField(n, T.DoubleType()) for n in rule.inputs] + [T.StructField(n, t) for n, t in rule.results]
    fields += [T.StructField("version", T.LongType()), T.StructField("late", T.BooleanType())]
    inputs = [F.col(c).cast("double").alias(c) for c in rule.inputs]
    return days.select(*keys, F.col("date").cast("date").alias("date"), *inputs).groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=Replay(keys, rule, keep_days), outputStructType=T.StructType(fields), outputMode="Append", timeMode="None")


def newest(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last version of each day that has a result: what a run over all days in order would give."""
    rest = [c for c in table.columns if c not in (*keys, "date", "version", "late")]
    last = table.where(~F.col("late")).groupBy(*keys, "date").agg(*[F.max_by(c, "version").alias(c) for c in rest])
    results = rest[-1:]  # a withdrawn day has null results
    return last.where(F.col(results[0]).isNotNull())


def late_days(table: DataFrame) -> DataFrame:
    """Days that came after their place was given up, with their values."""
    return table.where("late")


def late_counts(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many days each key lost that way, and from when to when."""
    return late_days(table).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_late"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def with_late_days(days: DataFrame, table: DataFrame, keys: Sequence[str], inputs: Sequence[str]) -> DataFrame:
    """The daily rows with the late ones put in, for a batch run over the whole record."""
    lost = late_days(table).groupBy(*keys, "date").agg(*[F.max_by(c, "version").alias(c) for c in inputs])
    kept = days.select(*keys, "date", *inputs).join(lost.select(*keys, "date"), [*keys, "date"], "left_anti")
    return kept.unionByName(lost)
