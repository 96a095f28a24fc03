"""Queue depth, latencies and sequentiality on a live stream of events, one state per log, for all three families.

A micro-batch of a log is put in order and goes through whole-column operations; state is read once and written once a
batch: a value with the carried scalars, and lists with outstanding requests and rows that wait. Rows that come in
another order than that of their times wait until the log's own time (of its latest row) is `delay` seconds beyond them;
without a delay each batch is taken as complete. A row that should have come before one that has been passed on is late: it
comes out with late = true and no values, and changes nothing.

A row with an infinite time closes its log: all that waits comes out, and what follows begins anew. Results then equal
those of the batch functions over the same rows (less late ones); without it the last rows, and custom requests that end
after the last start, are still waiting. Only logs with rows in a batch are touched.

State is lists and values of RocksDB, so the session must name its provider: see use_rocksdb(). What waits and what
is outstanding is held for each log; requests older than `expire` seconds of log time are given up if that is set.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schemas import BLOCK, CUSTOM, MILLISECONDS, UFS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DERIVED = {
    UFS: "qd long, dtoc double, ctoc double, ctod double, continuous boolean, late boolean",
    BLOCK: "qd long, dtoc double, ctoc double, ctod double, continuous boolean, late boolean",
    CUSTOM: "start_qd long, end_qd long, ctoc double, ctod double, continuous boolean, late boolean",
}
NOW = "scalars string"
OPEN = "what int, key string, time double"
PAIR, QUEUED, ISSUED = range(3)
CLASSES = {"R": "read", "W": "write", "D": "discard"}


def use_rocksdb(spark: SparkSession) -> None:
    """States with several lists need the RocksDB provider; queries that start later use it."""
    spark.conf.set(PROVIDER, ROCKSDB)


@contextmanager
def state_partitions(spark: SparkSession, logs: int) -> Iterator[None]:
    """Queries that start within have a partition of state for each log, and a core's worth at most: a partition without a log
    still costs each batch a task. A query keeps the number that it first started with."""
    name = "spark.sql.shuffle.partitions"
    old = spark.conf.get(name)
    spark.conf.set(name, str(max(1, min(logs, spark.sparkContext.defaultParallelism))))
    try:
        yield
    finally:
        spark.conf.set(name, old)


def _before(when: np.ndarray) -> tuple[np.ndarray, int]:
    """For each row, the place of the last row before it where `when` holds, -1 if there is none; and that of the last of all."""
    at = np.maximum.accumulate(np.append(-1, np.where(when, np.arange(len(when)), -1)))
    return at[:-1], int(at[-1])


def _at(values: np.ndarray, at: np.ndarray, first) -> np.ndarray:
    """The values at places; where there is none, `first`, or NaN."""
    first = np.nan if first is None else first
    return np.where(at < 0, first, values[at]) if len(values) else np.empty(0)


def _ms(later: np.ndarray, earlier: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(earlier), 0.0, (later - earlier) * MILLISECONDS)


def _whole(values) -> np.ndarray:
    """Whole numbers of any size."""
    numbers = list(map(int, values))
    try:
        return np.array(numbers, np.int64)
    except OverflowError:
        return np.array(numbers, object)


def _codes(*columns) -> tuple[np.ndarray, list[str]]:
    """A number for each row's key, and the text of each key."""
    frame = pd.DataFrame(dict(enumerate(columns)))
    codes = frame.groupby(list(frame.columns), sort=False, dropna=False).ngroup().to_numpy(np.int64)
    first = np.unique(codes, return_index=True)[1]
    return codes, [" ".join(map(str, r)) for r in frame.iloc[first].itertuples(index=False, name=None)]


def _by_key(codes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of rows where `which` holds, key by key in their order; whether the one before is of the same key; and it."""
    at = np.flatnonzero(which)
    at = at[np.argsort(codes[at], kind="stable")]
    before = np.append(-1, at[:-1])[: len(at)]
    return at, (before >= 0) & (codes[at] == codes[before]), before


def _follow(what: int, key: tuple[np.ndarray, list[str]], begins: np.ndarray, ends: np.ndarray, time: np.ndarray, open_: dict) -> np.ndarray:
    """For each row that ends something: the time of the open beginning of its key, which it takes away, or NaN. A new
    beginning takes the place of the old one, so only the row of the key before counts."""
    codes, names = key
    out = np.full(len(codes), np.nan)
    at, same, before = _by_key(codes, begins | ends)
    hit = same & ends[at] & begins[before]
    out[at[hit]] = time[before[hit]]
    for k in at[~same & ends[at]].tolist():
        out[k] = open_.get((what, names[codes[k]]), np.nan)
    for k in at[np.append(~same[1:], True)[: len(at)]].tolist():
        if begins[k]:
            open_[what, names[codes[k]]] = float(time[k])
        else:
            open_.pop((what, names[codes[k]]), None)
    return out


def _plain(value):
    return value.item() if isinstance(value, np.generic) else value


class _Log(StatefulProcessor):
    """What all families share: order, waiting, late rows, closing."""

    time, order = "time", ()

    def __init__(self, row: T.StructType, out: T.StructType, delay: float | None, expire: float | None):
        self.row, self.out, self.delay, self.expire = row, out, delay, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", NOW)
        self.waiting = handle.getListState("waiting", self.row)
        self.open = handle.getListState("open", OPEN)

    def close(self) -> None:
        pass

    @staticmethod
    def _put(state, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        elif state.exists():
            state.clear()

    def _frame(self, rows) -> pd.DataFrame:
        return pd.DataFrame(list(rows), columns=self.row.names)

    def keys(self, rows: pd.DataFrame) -> list[np.ndarray]:
        """The columns that rows are ordered by, time first."""
        raise NotImplementedError

    def derive(self, rows: pd.DataFrame, now: dict, open_: dict, frontier: float) -> pd.DataFrame:
        raise NotImplementedError

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)[self.row.names]
        now = json.loads(self.now.get()[0]) if self.now.exists() else {}
        open_ = {(w, k): t for w, k, t in self.open.get()} if self.open.exists() else {}
        time = batch[self.time].to_numpy(float)
        closing = bool(np.isinf(time).any())
        batch, time = batch[~np.isinf(time)], time[~np.isinf(time)]
        high = max([now.get("high", -np.inf), *([float(time.max())] if len(time) else [])])
        frontier = np.inf if closing else high if self.delay is None else high - self.delay
        late, same = np.zeros(len(batch), bool), np.ones(len(batch), bool)
        if "last" in now:
            for c, v in zip(self.keys(batch), now["last"]):
                late |= same & (c < v).astype(bool)
                same &= (c == v).astype(bool)
        lost, batch = batch[late], batch[~late]
        if self.waiting.exists():
            batch = pd.concat([self._frame(self.waiting.get()), batch], ignore_index=True)
        place = self.keys(batch)
        order = np.lexsort(place[::-1])
        ready = order if closing or self.delay is None else order[place[0][order] < frontier]
        some = batch.iloc[ready].reset_index(drop=True)
        if len(ready):
            now["last"] = [_plain(c[ready[-1]]) for c in place]
        out = self.derive(some, now, open_, frontier)
        if len(lost):
            out = pd.concat([out, lost.assign(late=True).reindex(columns=self.out.names)], ignore_index=True)
        if closing:
            now, open_, rest = {}, {}, []
        else:
            now["high"] = high
            rest = [tuple(r) for r in batch.iloc[order[len(ready) :]].itertuples(index=False, name=None)]
        if self.expire is not None:
            open_ = {k: t for k, t in open_.items() if t >= high - self.expire}
        self.now.update((json.dumps(now),))
        self._put(self.waiting, rest)
        self._put(self.open, [(w, k, t) for (w, k), t in open_.items()])
        yield self._typed(out)

    def _typed(self, out: pd.DataFrame) -> pd.DataFrame:
        whole = {"qd", "start_qd", "end_qd"}
        return pd.DataFrame({n: out[n].astype("Int64") if n in whole else out[n].astype("boolean") if n in ("continuous", "late") else out[n] for n in self.out.names})

    @staticmethod
    def depth(step: np.ndarray, first: int) -> np.ndarray:
        """A counter that never goes below 0, after each row."""
        s = first + np.cumsum(step)
        return s - np.minimum(0, np.minimum.accumulate(s)) if len(s) else s

    def common(self, time: np.ndarray, is_i: np.ndarray, is_c: np.ndarray, now: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """qd, and the times that ctoc and ctod count from."""
        qd = self.depth(is_i.astype(int) - is_c, now.get("qd", 0))
        now["qd"] = int(qd[-1]) if len(qd) else now.get("qd", 0)
        out = []
        for name, when in (("since", is_c | (is_i & (qd == 1))), ("idle", is_c & (qd == 0))):
            at, last = _before(when)
            out.append(_at(time, at, now.get(name)))
            now[name] = now.get(name) if last < 0 else float(time[last])
        return qd, *out

    @staticmethod
    def follows(here: np.ndarray, size: np.ndarray, what: np.ndarray, when: np.ndarray, now: dict) -> np.ndarray:
        """Whether a row begins where the last one before it, of those where `when` holds, ends, and is of the same sort."""
        if not len(here):
            return np.zeros(0, bool)
        at, last = _before(when)
        end = here + size
        out = (at >= 0) & (here == end[at]).astype(bool) & (what == what[at]).astype(bool)
        if now.get("next") is not None:
            out |= (at < 0) & (here == now["next"][0]).astype(bool) & (what == now["next"][1]).astype(bool)
        if last >= 0:
            now["next"] = [_plain(end[last]), what[last]]
        return out


class UfsLog(_Log):
    def keys(self, rows: pd.DataFrame) -> list[np.ndarray]:
        rank = rows["action"].str[:1].map({"c": 0, "s": 1}).fillna(2).to_numpy(int)
        return [rows["time"].to_numpy(float), rank, rows["tag"].to_numpy(), rows["line_ord"].to_numpy()]

    def derive(self, rows, now, open_, frontier):
        time, action = rows["time"].to_numpy(float), rows["action"].to_numpy(object)
        is_i, is_c = action == "send_req", action == "complete_rsp"
        qd, since, idle = self.common(time, is_i, is_c, now)
        sent = _follow(PAIR, _codes(rows["tag"], rows["opcode"]), is_i, is_c, time, open_)
        follows = self.follows(rows["lba"].to_numpy(), rows["size"].to_numpy(), rows["opcode"].to_numpy(object), is_i, now)
        return rows.assign(
            qd=qd, dtoc=_ms(time, sent), ctoc=np.where(is_c, _ms(time, since), 0.0), ctod=np.where(is_i & (qd == 1), _ms(time, idle), 0.0),
            continuous=is_i & follows, late=False,
        )


class BlockLog(_Log):
    def keys(self, rows: pd.DataFrame) -> list[np.ndarray]:
        return [rows["time"].to_numpy(float), _whole(rows["sector"]), rows["size"].to_numpy(), rows["line_ord"].to_numpy()]

    def derive(self, rows, now, open_, frontier):
        time, action, size = rows["time"].to_numpy(float), rows["action"].to_numpy(object), rows["size"].to_numpy()
        sector, kind = _whole(rows["sector"]), rows["io_type"].str[:1].map(CLASSES).fillna("other").to_numpy(object)
        queued = _codes(rows["devmajor"], rows["devminor"], sector, size, rows["comm"])
        first = _ms(time, _follow(QUEUED, queued, action == "Q", action == "C", time, open_))
        # Completions of empty writes go, then issues of what is outstanding already.
        issue, done = action == "block_rq_issue", action == "block_rq_complete"
        stays = ~(done & rows["io_type"].str.startswith("W").to_numpy(bool) & (size == 0))
        stays &= ~self.reissued(_codes(sector, kind, size), issue & stays, done & stays, time, open_)
        rows, time, first, kind, action, sector, size = rows[stays].reset_index(drop=True), time[stays], first[stays], kind[stays], action[stays], sector[stays], size[stays]
        is_i, is_c = np.isin(action, ("block_rq_issue", "Q")), np.isin(action, ("block_rq_complete", "C"))
        qd, since, idle = self.common(time, is_i, is_c, now)
        sent = _follow(PAIR, _codes(sector, kind), is_i, is_c, time, open_)
        known = is_i & (kind != "other")
        return rows.assign(
            qd=qd, dtoc=np.where(np.isnan(sent), first, _ms(time, sent)), ctoc=np.where(is_c, _ms(time, since), 0.0), ctod=np.where(is_i, _ms(time, idle), 0.0),
            continuous=known & self.follows(sector, size, kind, known, now), late=False,
        )

    @staticmethod
    def reissued(key: tuple[np.ndarray, list[str]], issue: np.ndarray, done: np.ndarray, time: np.ndarray, open_: dict) -> np.ndarray:
        """Issues of what is outstanding: those that come after an issue of their key. The first of them is what is open."""
        codes, names = key
        out = np.zeros(len(codes), bool)
        at, same, before = _by_key(codes, issue | done)
        out[at] = issue[at] & same & issue[before]
        for k in at[~same & issue[at]].tolist():
            out[k] = (ISSUED, names[codes[k]]) in open_
        begun = np.full(len(names), -1)
        fresh = at[issue[at] & ~out[at]]
        begun[codes[fresh]] = fresh  # the last of each key
        for k in at[np.append(~same[1:], True)[: len(at)]].tolist():
            if done[k]:
                open_.pop((ISSUED, names[codes[k]]), None)
            elif begun[codes[k]] >= 0:
                open_[ISSUED, names[codes[k]]] = float(time[begun[codes[k]]])
        return out


class CustomLog(_Log):
    """A request comes out once its end is behind the log's own time. Until then it waits with what is known of it."""

    time = "start_time"

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = T.StructType([*self.row.fields, *(f for f in self.out if f.name in ("start_qd", "ctoc", "ctod", "continuous"))])
        self.running = handle.getListState("running", self.held)

    def keys(self, rows: pd.DataFrame) -> list[np.ndarray]:
        return [rows["start_time"].to_numpy(float), *(rows[c].to_numpy() for c in ("lba", "size", "line_ord"))]

    def derive(self, rows, now, open_, frontier):
        start, end = rows["start_time"].to_numpy(float), rows["end_time"].to_numpy(float)
        at, last = _before(np.ones(len(rows), bool))
        before = _at(end, at, now.get("end"))
        now["end"] = now.get("end") if last < 0 else float(end[last])
        follows = self.follows(rows["lba"].to_numpy(), rows["size"].to_numpy(), rows["opcode"].to_numpy(object), np.ones(len(rows), bool), now)
        fresh = rows.assign(start_qd=pd.array([None] * len(rows), dtype="Int64"), ctoc=np.maximum(0, _ms(end, before)), ctod=np.maximum(0, _ms(start, before)), continuous=follows)
        if self.running.exists():
            held = pd.DataFrame(list(self.running.get()), columns=self.held.names).astype({"start_qd": "Int64", "continuous": bool})
            fresh = pd.concat([held, fresh], ignore_index=True)
        places, every = self.keys(fresh), np.arange(len(fresh))
        begins = np.flatnonzero(fresh["start_qd"].isna().to_numpy(bool))
        which, side = np.append(begins, every), np.append(np.zeros(len(begins), int), np.ones(len(every), int))
        time = np.append(places[0][begins], fresh["end_time"].to_numpy(float))
        order = np.lexsort((side, *(c[which] for c in places[::-1]), time))
        order = order[time[order] < frontier]
        which, side = which[order], side[order]
        qd = self.depth(1 - 2 * side, now.get("qd", 0))
        now["qd"] = int(qd[-1]) if len(qd) else now.get("qd", 0)
        depths = [np.full(len(fresh), -1, np.int64) for _ in range(2)]
        for k in (0, 1):
            depths[k][which[side == k]] = qd[side == k]
        fresh["start_qd"] = fresh["start_qd"].where(depths[0] < 0, pd.array(depths[0], dtype="Int64"))
        over = depths[1] >= 0
        self._put(self.running, [tuple(None if x is pd.NA else x for x in r) for r in fresh[~over].itertuples(index=False, name=None)])
        return fresh[over].assign(end_qd=depths[1][over], late=False).reindex(columns=self.out.names)


LOGS = {UFS: UfsLog, BLOCK: BlockLog, CUSTOM: CustomLog}


def derive(events: DataFrame, kind: str, delay: float | None = None, expire: float | None = None) -> DataFrame:
    """events(source, line_ord, ... of a family), streaming -> the same columns, derived ones, and late."""
    own = [c.split()[0] for c in DERIVED[kind].split(", ")]
    drop = own if kind == CUSTOM else [*own, "dtoc"]
    rows = events.drop(*drop)
    row = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    out = T.StructType([*row.fields, *T._parse_datatype_string(DERIVED[kind])])
    return rows.groupBy("source").transformWithStateInPandas(LOGS[kind](row, out, delay, expire), out, "Append", "None")


def closing(spark: SparkSession, sources: list[str], schema: T.StructType, kind: str) -> DataFrame:
    """A row for each log that closes it."""
    time = "start_time" if kind == CUSTOM else "time"
    fill = {"source": F.col("source"), "line_ord": F.lit(-1), time: F.lit(float("inf"))}
    texts = (T.StringType,)
    other = lambda f: F.lit("") if isinstance(f.dataType, texts) else F.lit(False) if isinstance(f.dataType, T.BooleanType) else F.lit(0)
    rows = spark.createDataFrame([(s,) for s in sources], "source string")
    return rows.select(*(fill.get(f.name, other(f)).cast(f.dataType).alias(f.name) for f in schema))
