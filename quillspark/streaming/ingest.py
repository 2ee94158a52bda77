"""Incremental ingest: files that arrive are assembled with the batch operators, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import assembly
from ..plans.manifest import Manifest
from ..sources.csv_source import Table


def ingest_stream(spark: SparkSession, folder: str, headers: Sequence[str], manifest: Manifest, out: str, checkpoint: str, delimiter: str = ",") -> StreamingQuery:
    """Read CSV files as they appear in folder and append their transformed rows to the Parquet table `out`.

    Each micro-batch is a survey export of its own: rows of one respondent must arrive together. Row numbers are unique
    within a batch; the partition column `batch` tells batches apart. Runs until the files present are done.
    """
    schema = ", ".join(f"c{i} string" for i in range(len(headers)))
    files = spark.readStream.schema(schema).options(header=True, sep=delimiter, multiLine=True, quote='"', escape='"').csv(folder)

    def each(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("row_number", F.monotonically_increasing_id() + 1)
        df, _ = assembly.transform(Table(rows, tuple(headers), "utf-8-sig", delimiter), manifest)
        safe = [c for c in df.columns if c != "row_number"]
        packed = df.select("row_number", F.create_map(*[x for c in safe for x in (F.lit(c), assembly.q(c))]).alias("cells"))
        # the batch number makes a batch that is run again replace its own rows
        packed.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
