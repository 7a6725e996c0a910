"""The replay as two streaming jobs over a folder of typed events."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from queuescope.streaming.replay import REPLAYED, replayed
from queuescope.streaming.traces import QUEUE_ROW, switches, timed, trace_rows


@dataclass
class ReplayJob:
    """From a folder of typed event files to a table of replayed queue rows.

    A first job closes traces and writes their queue rows, a second one replays them with the set
    records. Each writes files exactly once and goes on from its checkpoint, so the folder may grow
    between two runs, and a run may be broken off. ``delay`` is how late a record may come, ``idle``
    how long a trace may be silent, ``settle`` how far a row of a closed trace may lie behind the
    newest such row: as much as the longest trace lasts, and both of the others.
    """

    spark: SparkSession
    events: str
    schema: object
    out: str
    delay: str
    idle: str
    settle: str
    files: int = 1_000  #: event files that one batch takes
    queries: list[StreamingQuery] = field(default_factory=list)

    def _events(self) -> DataFrame:
        read = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", self.files)
        return read.option("recursiveFileLookup", "true").parquet(self.events)

    def _run(self, rows: DataFrame, name: str) -> None:
        """Everything that is there, in as many batches as it takes."""
        write = rows.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        query = write.option("checkpointLocation", f"{self.out}/checkpoints/{name}").start(f"{self.out}/{name}")
        try:
            query.awaitTermination()
        finally:
            query.stop()
        self.queries.append(query)

    def run(self) -> DataFrame:
        """Take in what is new; the table of all rows replayed so far."""
        self._run(trace_rows(self._events(), self.delay, self.idle), "traces")
        traces = self.spark.readStream.schema(QUEUE_ROW).parquet(f"{self.out}/traces")
        # Of the two watermarks Spark takes the earlier one, so sets wait for the traces of their time.
        rows = timed(traces, self.settle).unionByName(timed(switches(self._events()), self.delay))
        self._run(replayed(rows), "replayed")
        return self.spark.read.schema(REPLAYED).parquet(f"{self.out}/replayed")
