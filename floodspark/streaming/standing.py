"""One standing row per key over a stream, kept in state that ends.

Rows are reduced to one per key within each Arrow batch before they are
shuffled, so a key that holds a third of all rows reaches its state as a few
rows. A timer per key clears what has not been seen for a while.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

__all__ = ["combined", "opened", "standing_rows"]

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FORMATS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _reduced(pdf: pd.DataFrame, ranks: list[str], figures: dict[str, str]) -> pd.DataFrame:
    """One row per key: the row of the highest rank, the latest time seen, and the merged figures."""
    ranked = pdf.dropna(subset=ranks).sort_values(ranks, kind="stable", ascending=False).drop_duplicates("key")
    grouped = pdf.groupby("key", sort=False)
    out = {"seen": grouped["seen"].max()}
    for name, how in figures.items():
        out[name] = grouped[name].sum(min_count=1) if how == "sum" else grouped[name].agg(how)
    best = ranked.set_index("key")[[*ranks, "row"]]
    return pd.DataFrame(out).join(best).reset_index()


class _Standing(StatefulProcessor):
    """State of a key: when it was last seen, then ranks and content of the row that stands."""

    def __init__(self, state: T.StructType, n_ranks: int, keep_ms: int):
        self.schema, self.n, self.keep_ms = state, n_ranks, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("standing", self.schema)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.state.get()
        seen, *rank, row = (0, *[None] * (self.n + 1)) if before is None else before
        for new in rows:
            _, at, *offered, content = new[:self.n + 3]
            seen = max(seen, (at or 0) // 1000)
            if None not in offered and (row is None or offered > rank):
                rank, row = offered, content
        after = (seen, *rank, row)
        self.state.update(after)
        if before is None:
            # A timer has to lie ahead; once due it looks whether the key was seen since.
            self.handle.registerTimer(max(seen + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        if before is None or tuple(before)[1:] != after[1:]:
            yield Row(key=key[0], row=row)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = self.state.get()[0] + self.keep_ms
        if due > timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
        else:
            self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def combined(rows: DataFrame, keys: Sequence[str], rank: Sequence[Column], content: Sequence[str], seen: Column | None,
             figures: dict[str, tuple[str, Column]]) -> DataFrame:
    """One row per key and Arrow batch: ``key`` and ``row`` as JSON, ``seen`` in microseconds, ranks, and merged figures."""
    hows = {name: how for name, (how, _) in figures.items()}
    ranks = [f"rank{k}" for k in range(len(rank))]
    slim = rows.select(
        F.to_json(F.struct(*keys), FORMATS).alias("key"),
        F.unix_micros(F.current_timestamp() if seen is None else seen).alias("seen"),
        *[r.alias(n) for r, n in zip(rank, ranks)], F.to_json(F.struct(*content), FORMATS).alias("row"),
        *[c.cast("double").alias(n) for n, (_, c) in figures.items()])

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield _reduced(pdf, ranks, hows)[["key", "seen", *ranks, "row", *hows]]

    return slim.mapInPandas(combine, T.StructType([T.StructField(f.name, f.dataType) for f in slim.schema.fields]))


def opened(rows: DataFrame, schema: T.StructType, keys: Sequence[str], content: Sequence[str], figures: Sequence[str] = ()) -> DataFrame:
    """Keys, content and figures as columns again; a key without a standing row has no content."""
    parsed = lambda c, some: F.from_json(c, T.StructType([schema[n] for n in some]), FORMATS)
    return rows.select(parsed("key", keys).alias("_k"), parsed("row", content).alias("_c"), *figures).select(
        *[F.col(f"_k.{n}").alias(n) for n in keys], *[F.col(f"_c.{n}").alias(n) for n in content], *figures)


def standing_rows(rows: DataFrame, keys: Sequence[str], rank: Sequence[Column], content: Sequence[str], keep_s: int,
                  seen: Column | None = None, watermark: str = "1 hour") -> DataFrame:
    """Per key: ``content`` of the row with the highest rank so far; update mode.

    A row with a null in its rank never stands; of equal ranks one stands. State of a key is cleared once it was not
    seen for ``keep_s``, measured by the event time ``seen`` behind its watermark; where ``seen`` is None, the time of
    the micro-batch counts as event time. A key that comes back later starts anew. Rows older than the watermark are
    dropped.
    """
    rows.sparkSession.conf.set(STORE, ROCKSDB)  # the only store that keeps timers
    few = combined(rows, keys, rank, content, seen, {})
    state = T.StructType([f for f in few.schema.fields if f.name != "key"])
    few = few.withColumn("event_time", F.timestamp_micros("seen")).withWatermark("event_time", watermark)
    out = few.groupBy("key").transformWithState(
        _Standing(state, len(rank), int(keep_s) * 1000), "key string, row string", "Update", "EventTime")
    return opened(out, rows.schema, keys, content)
