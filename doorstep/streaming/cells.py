"""Cell state and miss ladder as keyed state with timers."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from doorstep.operators.cells import HOT_AT, REVIVE_AFTER_DAYS
from doorstep.operators.observe import BACKOFF_DAYS

# The processors travel with the job, so workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CELL_STATE = "status string, next_page bigint, total_yield bigint, at bigint"
CELL_OUTPUT = (
    "cell_id bigint, searched_at timestamp, status string, next_page bigint, "
    "new_yield bigint, total_yield bigint, revived boolean"
)
LADDER_OUTPUT = (
    "business_id bigint, question string, misses bigint, last_miss_at timestamp, "
    "retry_after timestamp"
)
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000

# Keys share slots: a call of Python and its state then take a slot's keys of a batch at once, by column.
# A batch reads and writes the slots its keys fall into, one of SLOTS parts of the state each.
SLOTS = 1024
SLOT, KEY = "doorstep_slot", "doorstep_key"
SLOT_STATE = "rows binary"
#: A time that is not there.
NEVER = np.iinfo(np.int64).min


def _micros(value: pd.Timestamp) -> int:
    return pd.Timestamp(value).value // 1000


def _time(micros: int | None):
    return None if micros is None else dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=micros)


class CellMachine(StatefulProcessor):
    """One row out per pass; a timer returns a long-exhausted cell to pending."""

    def __init__(self, revive_after_days: int = REVIVE_AFTER_DAYS) -> None:
        self.revive_after = revive_after_days * DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cell = handle.getValueState("cell", CELL_STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (cell_id,) = key
        passes = pd.concat(list(rows)).sort_values("searched_at")
        status, page, total, at = self.cell.get() if self.cell.exists() else ("pending", 1, 0, None)
        out = []
        for when, new, seen in zip(passes.searched_at, passes.new_count, passes.total_count):
            now = _micros(when)
            revived = status == "exhausted" and at < now - self.revive_after
            if revived:
                status, page = "pending", 1
            if new > 0:
                status, page = ("hot" if new >= HOT_AT else "cooling"), page + 1
            else:
                status = "exhausted" if status in ("struck", "exhausted") else "struck"
            total, at = total + int(seen), now
            out.append((cell_id, when, status, page, int(new), total, revived))
        self.cell.update((status, page, total, at))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "exhausted":
            self.handle.registerTimer((at + self.revive_after) // 1000 + 1)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CELL_OUTPUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (cell_id,) = key
        status, page, total, at = self.cell.get()
        if status == "exhausted":
            self.cell.update(("pending", 1, total, at))
            due = expiredTimerInfo.getExpiryTimeInMs() * 1000
            yield pd.DataFrame(
                [(cell_id, _time(due), "pending", 1, 0, total, True)],
                columns=[c.split()[0] for c in CELL_OUTPUT.split(", ")],
            )
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def _micros_of(times: pd.Series) -> np.ndarray:
    """Microseconds of a column of times; no time is the earliest there is."""
    times = times.to_numpy().astype("datetime64[us]")
    return np.where(np.isnat(times), _micros(pd.NaT), times.astype(np.int64))


def _whole(values: pd.Series, absent: pd.Series) -> pd.api.extensions.ExtensionArray:
    """Whole numbers, exact beside nulls."""
    return pd.arrays.IntegerArray(values.to_numpy(np.int64), absent.to_numpy(bool))


def _kept(state) -> pd.DataFrame | None:
    """Rows that a value state holds as one Arrow stream."""
    if not state.exists():
        return None
    (held,) = state.get()
    return pa.ipc.open_stream(pa.py_buffer(bytes(held))).read_pandas()


def _keep(state, rows: pd.DataFrame) -> None:
    table = pa.Table.from_pandas(rows, preserve_index=False).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as stream:
        stream.write_table(table)
    state.update((sink.getvalue().to_pybytes(),))


def _one_timer(handle: StatefulProcessorHandle, due: int | None) -> None:
    """A slot's only timer, at `due` milliseconds."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    if due is not None:
        handle.registerTimer(due)


def _folded(ladders: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
    """`key`, misses and time of the last of every key, after facts in the order of time and id."""
    known = len(ladders)
    code, keys = pd.factorize(pd.concat([ladders[KEY], facts[KEY]], ignore_index=True))
    order = np.lexsort((facts["id"].to_numpy(), facts["at"].to_numpy()))
    code, at = code[known:][order], facts["at"].to_numpy()[order]
    status = facts["status"].to_numpy()[order]
    place = np.arange(len(order))
    answered = np.full(len(keys), -1)
    answers = np.flatnonzero(status == "ok")
    answered[code[answers]] = answers  # the last of several stays
    live = np.flatnonzero((status == "no_data") & (place > answered[code]))
    misses = np.bincount(code[live], minlength=len(keys))
    last = np.full(len(keys), NEVER)
    last[code[live]] = at[live]
    goes_on = answered[:known] < 0
    misses[:known] += np.where(goes_on, ladders["misses"].to_numpy(), 0)
    last[:known] = np.where(goes_on & (last[:known] == NEVER), ladders["at"].to_numpy(), last[:known])
    return pd.DataFrame({KEY: keys, "misses": misses, "at": last})


class MissLadder(StatefulProcessor):
    """Running miss count in event order; a good answer clears it, blocked and failed lookups do not count.

    A slot holds the keys that hash to it. Observations that the watermark has not passed are kept one
    by one, and every row given out has them folded in event order, whatever the order of arrival.
    What the watermark has passed is folded into the ladders for good, by input or by timer, so the
    state holds the rows of one lateness and two numbers per key. A repeated observation (time and id)
    counts once.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ladders = handle.getValueState("ladders", SLOT_STATE)
        self.open = handle.getValueState("open", SLOT_STATE)

    def _settled_ladders(self) -> pd.DataFrame:
        held = _kept(self.ladders)
        return pd.DataFrame({KEY: pd.Series(dtype=object), "misses": np.zeros(0, np.int64), "at": np.zeros(0, np.int64)}) if held is None else held

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        at = initialState["last_miss_at"]
        begun = pd.DataFrame({
            KEY: initialState[KEY], "misses": initialState["misses"].astype(np.int64),
            "at": np.where(at.isna(), NEVER, _micros_of(at)),
        })
        both = pd.concat([self._settled_ladders(), begun], ignore_index=True)
        _keep(self.ladders, both.drop_duplicates(KEY, keep="last"))

    def _settled(self, until: int, fresh: pd.DataFrame | None = None) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The ladders with everything before `until` folded in for good, and the facts still open."""
        parts = [part for part in (_kept(self.open), fresh) if part is not None]
        facts = pd.concat(parts, ignore_index=True).drop_duplicates([KEY, "at", "id"], keep="last")
        ladders = self._settled_ladders()
        passed = facts["at"] < until
        if passed.any():
            ladders = _folded(ladders, facts[passed])
            _keep(self.ladders, ladders)
        rest = facts[~passed]
        if len(rest):
            _keep(self.open, rest)
        else:
            self.open.clear()
        _one_timer(self.handle, int(rest["at"].min()) // 1000 + 1 if len(rest) else None)
        return ladders, rest

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        facts = pd.concat(list(rows), ignore_index=True)
        if facts.empty:
            return
        fresh = pd.DataFrame({KEY: facts[KEY], "at": _micros_of(facts["fetched_at"]), "id": facts["id"], "status": facts["status"]})
        ladders, rest = self._settled(timerValues.getCurrentWatermarkInMs() * 1000, fresh)
        asked = facts.drop_duplicates(KEY)
        now = _folded(ladders[ladders[KEY].isin(asked[KEY])], rest[rest[KEY].isin(asked[KEY])]).set_index(KEY).loc[asked[KEY]]
        misses, at = now["misses"].to_numpy(), now["at"].to_numpy()
        waits = (misses >= 1) & (misses <= len(BACKOFF_DAYS)) & (at != NEVER)
        backoff = np.array([0, *BACKOFF_DAYS])[np.where(waits, misses, 0)] * DAY
        yield pd.DataFrame(
            {
                "business_id": _whole(asked["business"], asked["nameless"]),
                "question": asked["question"].to_numpy(), "misses": misses,
                "last_miss_at": at.view("datetime64[us]"),
                "retry_after": np.where(waits, at + backoff, NEVER).view("datetime64[us]"),
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # The rows given out last hold what is settled now.
        self._settled(timerValues.getCurrentWatermarkInMs() * 1000)
        yield pd.DataFrame()

    def close(self) -> None:
        pass


class FirstRow(StatefulProcessor):
    """The earliest row of each of a slot's keys, given out once the watermark has passed it."""

    def __init__(self, columns: list[str], order: list[str], absent: dict[str, str]) -> None:
        self.columns, self.order, self.absent = columns, order, absent
        # Nulls come last.
        self.by = [name for c in order for name in ([absent[c], c] if c in absent else [c])]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", SLOT_STATE)
        self.given = handle.getValueState("given", SLOT_STATE)

    def _wait(self, rows: pd.DataFrame) -> None:
        """Hold `rows`, and wake up when the watermark has passed the earliest."""
        if len(rows):
            _keep(self.first, rows)
        else:
            self.first.clear()
        _one_timer(self.handle, int(self._due(rows).min()) if len(rows) else None)

    def _due(self, rows: pd.DataFrame) -> np.ndarray:
        return _micros_of(rows[self.order[0]]) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows), ignore_index=True)[[*self.columns, *self.absent.values(), KEY]]
        given = _kept(self.given)
        if given is not None:
            every = every[~every[KEY].isin(given[KEY])]
        if len(every):
            held = _kept(self.first)
            if held is not None:
                every = pd.concat([held, every], ignore_index=True)
            self._wait(every.sort_values(self.by, kind="stable").drop_duplicates(KEY))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = _kept(self.first)
        passed = self._due(held) < timerValues.getCurrentWatermarkInMs()
        out, given = held[passed], _kept(self.given)
        _keep(self.given, out[[KEY]] if given is None else pd.concat([given, out[[KEY]]], ignore_index=True))
        self._wait(held[~passed])
        yield pd.DataFrame({c: _whole(out[c], out[self.absent[c]]) if c in self.absent else out[c].to_numpy() for c in self.columns})

    def close(self) -> None:
        pass


def _slotted(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """`rows` with their key as one text, exact for any columns, and the slot it hashes to."""
    texts = [F.col(c).cast("string") for c in key]
    whole = F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])
    return rows.withColumn(KEY, whole).withColumn(SLOT, F.pmod(F.xxhash64(KEY), F.lit(SLOTS)).cast("int"))


def cell_states(
    passes: DataFrame, lateness: str, revive_after_days: int = REVIVE_AFTER_DAYS
) -> DataFrame:
    """State after every pass of a stream of cell passes; needs the RocksDB state store."""
    return (
        passes.withWatermark("searched_at", lateness)
        .groupBy("cell_id")
        .transformWithStateInPandas(
            statefulProcessor=CellMachine(revive_after_days), outputStructType=CELL_OUTPUT,
            outputMode="Append", timeMode="EventTime",
        )
    )


def miss_ladders(observations: DataFrame, lateness: str, history: DataFrame | None = None) -> DataFrame:
    """Miss ladder after every batch, for observations carrying `question`.

    Observations may arrive in any order within `lateness`; later ones are dropped. `history`, a
    batch ladder (business_id, question, misses, last_miss_at), is where the stream goes on from.
    Needs the RocksDB state store.
    """
    key = ("business_id", "question")
    begun = None if history is None else _slotted(
        history.select(*key, "misses", "last_miss_at"), key
    ).groupBy(SLOT)
    named = _slotted(
        observations.select(*key, "fetched_at", "id", "status").withWatermark("fetched_at", lateness), key
    )
    return (
        named.select(
            SLOT, KEY, F.coalesce(F.col("business_id").cast("bigint"), F.lit(0)).alias("business"),
            F.col("business_id").isNull().alias("nameless"), "question", "fetched_at", "id", "status",
        )
        .groupBy(SLOT)
        .transformWithStateInPandas(
            statefulProcessor=MissLadder(), outputStructType=LADDER_OUTPUT,
            outputMode="Update", timeMode="EventTime", initialState=begun,
        )
    )


def first_rows(rows: DataFrame, at: str, lateness: str, key: list[str], tie: list[str]) -> DataFrame:
    """The first row of every key by (`at`, `tie`), whatever the order of arrival within `lateness`.

    A row comes out once the watermark has passed its time; from then on the key is known and its
    later rows are dropped. State is one row per key, then its name. Needs the RocksDB state store.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    slotted = _slotted(rows.withWatermark(at, lateness), key)
    # Whole numbers beside nulls would be read as floating ones.
    whole = [f.name for f in rows.schema.fields if isinstance(f.dataType, IntegralType)]
    absent = {c: f"doorstep_null_{i}" for i, c in enumerate(whole)}
    for c, flag in absent.items():
        slotted = slotted.withColumn(flag, F.col(c).isNull()).withColumn(c, F.coalesce(c, F.lit(0)))
    return slotted.groupBy(SLOT).transformWithStateInPandas(
        statefulProcessor=FirstRow(rows.columns, [at, *tie], absent), outputStructType=schema,
        outputMode="Append", timeMode="EventTime",
    )
