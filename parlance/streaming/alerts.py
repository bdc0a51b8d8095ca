"""Alerts raised once per message, from a stream of reactions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parlance.operators.feedback import NEGATIVE

GROUPS = 4096

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
_STATE = "messages binary"
_COUNTED = ["negatives", "alerted", "latest", "expires", "touched"]


def _partial_counts(keys: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Negative reactions per key and minute, counted before the shuffle, so a hot message sends a row a minute and batch.

    The newest reaction of a batch goes along with a count of 0 if it is not negative: it moves the watermark.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            newest = pc.max(rows["__at"])
            rows = rows.filter(pc.or_(pc.equal(rows["__n"], 1), pc.equal(rows["__at"], newest)))
            found = rows.group_by([*keys, "__minute"]).aggregate([("__at", "max"), ("__n", "sum")])
            yield from found.select([*keys, "__at_max", "__n_sum"]).rename_columns([*keys, "__at", "__n"]).to_batches()

    return count


def _table(names: list[str], columns: dict[str, object], rows: int) -> pa.Table:
    return pa.table([pa.array(columns[n], pa.string(), from_pandas=True) for n in names]
                    + [pa.array(columns.get(n, np.zeros(rows, np.int64)), pa.int64()) for n in _COUNTED], names=[*names, *_COUNTED])


def _watch(names: list[str], above: int, keep_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """The messages of one group at once: an Arrow table of them is the state, the earliest end of a message the timer."""
    def watch(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        parts = [pa.ipc.open_stream(bytes(state.get[0])).read_all()] if state.exists else []
        for frame in frames:
            frame = frame[frame["__n"] > 0] if len(frame) else frame
            if len(frame):
                counted = {"negatives": frame["__n"], "latest": frame["__ms"], "touched": np.ones(len(frame), np.int64)}
                parts.append(_table(names, {**{n: frame[n] for n in names}, **counted}, len(frame)))
        if not parts:
            return
        found = pa.concat_tables(parts).group_by(names).aggregate([("negatives", "sum"), *[(n, "max") for n in _COUNTED[1:]]])
        found = found.select([*names, "negatives_sum", *[f"{n}_max" for n in _COUNTED[1:]]]).rename_columns([*names, *_COUNTED])
        negatives, alerted, latest, expires, touched = (found[n].to_numpy() for n in _COUNTED)
        raised = (touched == 1) & (alerted == 0) & (negatives > above)
        expires = np.where(touched == 1, np.maximum(latest, now) + keep_ms, expires)
        live = expires >= now
        if live.any():
            counted = {"negatives": negatives, "alerted": np.where(raised, 1, alerted), "latest": latest, "expires": expires}
            left = _table(names, {**{n: found[n].to_pylist() for n in names}, **counted}, len(found)).filter(pa.array(live))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, left.schema) as out:
                out.write_table(left)
            state.update((sink.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(int(expires[live].min()))
        elif state.exists:
            state.remove()
        if raised.any():
            own = {n: found[n].filter(pa.array(raised)).to_pylist() for n in names}
            yield pd.DataFrame({**own, "negative_count": negatives[raised], "alerted_at": pd.to_datetime(latest[raised], unit="ms")})

    return watch


def _as_text(field: T.StructField) -> Column:
    """A key as a string from which ``_from_text`` makes the same key; NULL stays NULL."""
    key = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(key).cast("string")
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(key)
    if isinstance(field.dataType, (T.StructType, T.ArrayType)):
        return F.when(key.isNotNull(), F.to_json(F.struct(key.alias("k")), _JSON))
    return key.cast("string")


def _from_text(field: T.StructField, text: Column) -> Column:
    if isinstance(field.dataType, T.TimestampType):
        return F.timestamp_micros(text.cast("long"))
    if isinstance(field.dataType, T.BinaryType):
        return F.unhex(text)
    if isinstance(field.dataType, (T.StructType, T.ArrayType)):
        return F.from_json(text, T.StructType().add("k", field.dataType), _JSON)["k"]
    return text.cast(field.dataType)


def alert_stream(reactions: DataFrame, ts_col: str, keys: list[str], above: int = 0, delay: str = "1 hour", keep_hours: float = 24,
                 negative: list[str] = NEGATIVE, reaction_col: str = "reaction", groups: int = GROUPS) -> DataFrame:
    """keys, negative_count, alerted_at: one row for each message at the moment its negative reactions exceed ``above``.

    Of each message its negatives so far, whether the alert is out, and its end are kept.  The state survives restarts with the
    checkpoint, so an alert is not raised again.  ``keep_hours`` after its last negative reaction, in event time, a message is
    forgotten; negatives after that count anew.  Reactions more than ``delay`` older than the newest one of earlier batches
    are left out (to the minute), and so are those without a time.  NULL keys form messages of their own.

    Messages share ``groups`` states and timers by a hash of their keys, so a batch makes a call for a group and not for a
    message.  A batch rewrites the states of the groups it touches.  The number is fixed for the life of a checkpoint.
    """
    at = F.col(ts_col).cast("timestamp")
    is_negative = F.coalesce(F.col(reaction_col).isin(*negative), F.lit(False)).cast("long")
    own = [reactions.schema[k] for k in keys]
    names = [f"__key{i}" for i in range(len(keys))]
    texts = [_as_text(f).alias(n) for f, n in zip(own, names)]
    timed = reactions.select(*texts, at.alias("__at"), F.date_trunc("minute", at).alias("__minute"), is_negative.alias("__n")).where(
        "__at is not null")
    as_text = [T.StructField(n, T.StringType()) for n in names]
    counted = timed.mapInArrow(_partial_counts(names), T.StructType(list(as_text)).add("__at", "timestamp").add("__n", "long"))
    marked = counted.withWatermark("__at", delay).withColumn("__ms", F.unix_millis("__at")).withColumn(
        "__group", F.pmod(F.xxhash64(*names), F.lit(groups)))
    alerts = marked.groupBy("__group").applyInPandasWithState(
        _watch(names, above, int(keep_hours * 3_600_000)),
        T.StructType(list(as_text)).add("negative_count", "long").add("alerted_at", "timestamp"), _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return alerts.select(*[_from_text(f, F.col(n)).alias(f.name) for f, n in zip(own, names)], "negative_count", "alerted_at")
