"""A retry queue that drains: attempts come as a stream, timers bring a URL up again, and states end as the batch's do.

``crawl.attempt_state`` computes states of all attempts; here each URL keeps its state
between micro-batches, a timer in event time tells when a failed one is due, and what
fails its last retry is handed over once.  URLs are hashed to groups, whose states are
read, changed and kept together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from threadloom.operators.crawl import EXTERNAL_RETRIES, RETRIES

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: What a row says: a URL's state after a micro-batch, or that a failed one is due again.
OUT = "url string, is_external boolean, attempts int, state string, kind string, due timestamp"


#: Groups that URLs are hashed to: calls to the state store follow groups, not URLs.
GROUPS = 1024
#: No time, in milliseconds.
NONE = np.iinfo(np.int64).min
KEY = ["url", "external"]


class _Queue(StatefulProcessor):
    """The URLs of a group: attempts so far, whether one was answered, when each is due; and a timer for the first that is."""

    def __init__(self, retries: int, external_retries: int, wait_ms: int):
        self.retries, self.external_retries, self.wait_ms = retries, external_retries, wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "url array<string>, external array<int>, attempts array<int>, good array<boolean>, due array<bigint>, timer bigint")

    def _load(self) -> tuple[pd.DataFrame, int]:
        """States of the group's URLs, and the timer that is set."""
        *held, timer = self.held.get() if self.held.exists() else ([], [], [], [], [], NONE)
        kinds = {"url": object, "external": "int64", "attempts": "int64", "good": bool, "due": "int64"}
        return pd.DataFrame({c: pd.Series(list(x), dtype=kind) for (c, kind), x in zip(kinds.items(), held)}), timer

    def _save(self, urls: pd.DataFrame, timer: int) -> None:
        """Keep the states, and set the timer of the first URL that is due."""
        due = urls["due"][urls["due"] != NONE]
        first = int(due.min()) if len(due) else NONE
        if timer not in (NONE, first):
            self.handle.deleteTimer(timer)
        if first not in (NONE, timer):
            self.handle.registerTimer(first)
        self.held.update((*(urls[c].tolist() for c in (*KEY, "attempts", "good", "due")), first))

    def _open(self, urls: pd.DataFrame) -> pd.Series:
        """Whether a URL may be tried again, unless it was answered."""
        return urls["attempts"] < np.where(urls["external"] == 1, self.external_retries, self.retries) + 1

    def _said(self, urls: pd.DataFrame, kind: str) -> pd.DataFrame:
        external = pd.arrays.BooleanArray((urls["external"] == 1).to_numpy(), (urls["external"] < 0).to_numpy())
        state = np.where(urls["good"], "stored", np.where(self._open(urls), "retry", "failed"))
        due = urls["due"].to_numpy() if kind == "due" else np.full(len(urls), NONE)
        columns = {"url": urls["url"].to_numpy(), "is_external": external, "attempts": urls["attempts"].to_numpy("int32"), "state": state, "kind": kind}
        return pd.DataFrame(columns | {"due": due.astype("datetime64[ms]").astype("datetime64[ns]")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        urls, timer = self._load()
        urls["at"], urls["new"] = NONE, False
        for some in rows:
            at = some["at"].astype("datetime64[ms]").astype("int64")
            new = pd.DataFrame({"url": some["url"], "external": some["external"], "attempts": some["attempt"].fillna(0).astype("int64"), "good": some["good"].astype(bool)})
            # folded in as they come: what is held follows the group's URLs, not its attempts
            both = pd.concat([urls, new.assign(due=NONE, at=at, new=True)], ignore_index=True)
            urls = both.groupby(KEY, dropna=False, sort=False, as_index=False).max()
        urls["url"] = urls["url"].astype(object).where(urls["url"].notna(), None)
        # a URL that may be tried again comes up when event time has passed its wait
        waits = (urls["at"] != NONE) & ~urls["good"] & self._open(urls)
        urls["due"] = np.where(urls["new"], np.where(waits, urls["at"] + self.wait_ms, NONE), urls["due"])
        self._save(urls, timer)
        yield self._said(urls[urls["new"]], "state")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        urls, timer = self._load()
        expired = expiredTimerInfo.getExpiryTimeInMs()
        if timer == expired:
            up = (urls["due"] != NONE) & (urls["due"] <= max(expired, timerValues.getCurrentWatermarkInMs()))
            out = self._said(urls[up], "due")
            urls["due"] = urls["due"].where(~up, NONE)
            self._save(urls, NONE)
            yield out

    def close(self) -> None:
        pass


def drained(attempts: DataFrame, retries: int = RETRIES, external_retries: int = EXTERNAL_RETRIES, wait: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """States and due retries of a stream of attempts (url, attempt, is_external, status, error, at).

    ``at`` is when an attempt ended; an error status counts as a failed attempt.  The session needs the state
    store ``PROVIDER``.  A state follows each micro-batch that holds the URL; ``due`` rows tell which
    URLs are to be fetched again, once for each wait.
    """
    good = F.coalesce(F.col("error").isNull() & (F.col("status") < 400), F.lit(False))
    external = F.coalesce(F.col("is_external").cast("int"), F.lit(-1)).alias("external")
    group = F.pmod(F.xxhash64("url", "is_external"), F.lit(GROUPS)).cast("int").alias("group")
    rows = attempts.select(group, "url", external, "attempt", good.alias("good"), "at").withWatermark("at", late)
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    return rows.groupBy("group").transformWithStateInPandas(
        statefulProcessor=_Queue(retries, external_retries, wait_ms), outputStructType=OUT, outputMode="Update", timeMode="EventTime"
    )


def store(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Append what the stream says to ``path``, with the number of the micro-batch; a replayed one replaces its rows."""

    def write(rows: DataFrame, number: int) -> None:
        marked = rows.withColumn("batch", F.lit(number))
        marked.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def last_states(said: DataFrame) -> DataFrame:
    """(url, is_external, attempts, state): what was said last of each URL."""
    rows = said.where("kind = 'state'").groupBy("url", "is_external").agg(F.max_by(F.struct("attempts", "state"), "batch").alias("s"))
    return rows.select("url", "is_external", "s.attempts", "s.state")
