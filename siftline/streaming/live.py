"""What streams do, as a table: a listener writes an event for each start, batch and end."""

from __future__ import annotations

import itertools
import json
import threading
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from siftline.operators.segments import Store

EVENTS = "query string, run string, number long, at double, state string, batch long, rows long, error string"


class LiveStatus(StreamingQueryListener):
    """Every event of the session's streams as a small file in a folder that driver and readers share."""

    def __init__(self, spark: SparkSession, path: str, clock=time.time):
        self.spark, self.store, self.clock = spark, Store(spark, path), clock
        self.path, self.number, self.running = path, itertools.count(1), set()
        self.heard = threading.Event()

    def __enter__(self) -> LiveStatus:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def _write(self, query, run, state: str, batch: int | None = None, rows: int | None = None, error: str | None = None) -> None:
        number = next(self.number)
        told = {"query": str(query), "run": str(run), "number": number, "at": self.clock(), "state": state, "batch": batch, "rows": rows, "error": error}
        self.store.write_new(f"e-{number:09d}-{uuid.uuid4().hex}.json", json.dumps(told))

    def onQueryStarted(self, event) -> None:
        self.running.add(str(event.runId))
        self.heard.clear()
        self._write(event.name or event.id, event.runId, "started")

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self._write(p.name or p.id, p.runId, "running", p.batchId, p.numInputRows)

    def onQueryIdle(self, event) -> None:
        self._write(event.id, event.runId, "idle")

    def onQueryTerminated(self, event) -> None:
        self._write(event.id, event.runId, "failed" if event.exception else "finished", error=event.exception)
        self.running.discard(str(event.runId))
        if not self.running:
            self.heard.set()

    def settled(self, seconds: float = 30.0) -> bool:
        """Wait until the listener, which is told a little later, has heard of the end of every run that it knows."""
        return self.heard.wait(seconds)

    def events(self) -> DataFrame:
        """All events so far."""
        return self.spark.read.schema(EVENTS).json(self.path)

    def now(self) -> DataFrame:
        """One row a run: its query's name, latest state, batches and rows so far, and when that was told."""
        return self.events().groupBy("run").agg(
            F.min_by("query", "number").alias("query"), F.max_by("state", "number").alias("state"), F.count_distinct(F.when(F.col("rows") > 0, F.col("batch"))).alias("batches"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.max("at").alias("at"),
        )
