"""Points that keep coming: each batch of new files is one run on the store."""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..config import ShatterConfig
from ..jobs import shatter
from ..sources.store import Storage


def ingest(spark: SparkSession, store: str, folder: str, schema: StructType, checkpoint: str, date: datetime, once: bool = True):
    """A streaming query over a folder of Parquet points. A batch's run is named after the checkpoint and its
    number, so a batch that is tried again replaces its own cells, and no other stream's."""
    stream = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:12]

    def one(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        storage, name = Storage.from_db(batch.sparkSession, store), f"batch-{stream}-{number}"
        known = [p for p in storage.processes() if p.name == name]
        run = known[0] if known else ShatterConfig(store, folder, date, name=name)
        run.mbr = []
        shatter(batch.sparkSession, run, batch)

    writer = spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
