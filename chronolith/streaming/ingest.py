"""Continuous loads: every micro-batch of new CSV files is a load of its own."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.catalog import TemporalTable
from ..sources.csv_load import append, csv_rows


def follow_csv(spark: SparkSession, table: TemporalTable, folder: str, checkpoint: str, separator: str = ",", null_string: str = "null", **options: str) -> StreamingQuery:
    """Append files as they arrive in a folder, until none is left (``availableNow``); run it again for later ones.

    Rows with a bad period are set aside, malformed values fail the load, as in a batch load,
    whose options it takes.  The checkpoint remembers which files were loaded; a micro-batch
    that is replayed writes its load again in the same place.
    """
    rows = csv_rows(spark.readStream, folder, table.schema, separator=separator, null_string=null_string, **options)
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def load(batch: DataFrame, number: int) -> None:
        append(batch.sparkSession, table, batch, quarantine=True, name=f"{own}-{number:010}")

    return rows.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
