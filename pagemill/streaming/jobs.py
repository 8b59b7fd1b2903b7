"""The job fold as a stream, and the discovery loop. Both use the same functions as the batch operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.operators import jobs

_FIELDS = [c.split()[0] for c in jobs.STATE_SCHEMA.split(", ")][1:]
_STATE = jobs.STATE_SCHEMA.removeprefix("job_id string, ")


def fold_stream(events: DataFrame) -> DataFrame:
    """The state of each job after each micro-batch that touched it; events in order across batches, any order within one."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = jobs.State(**dict(zip(_FIELDS, group.get, strict=True))) if group.exists else jobs.State()
        rows = [row for f in frames for row in jobs._rows(f)]
        state = jobs.fold(state, rows)
        group.update(tuple(asdict(state)[f] for f in _FIELDS))
        yield pd.DataFrame([{"job_id": key[0], **asdict(state)}])

    own = events.select(*jobs.EVENT_COLUMNS)
    return own.groupBy("job_id").applyInPandasWithState(run, jobs.STATE_SCHEMA, _STATE, "update", GroupStateTimeout.NoTimeout)


def discover(spark: SparkSession, folder: str, checkpoint: str, each: Callable[[DataFrame, int], None], pattern: str = "*", every: str | None = None, files: int = 1000) -> StreamingQuery:
    """Watch a folder: new files reach each(batch, number) once, as (path, modificationTime, length, content).

    Without an interval it takes what is there and ends; files bounds a micro-batch. The checkpoint remembers what was
    seen, so a restarted query goes on where it stopped.
    """
    source = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(folder)
    )
    writer = source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
