"""Progressive results while an acquisition arrives."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from ..operators import detect, select
from ..operators.dense import masked_sums


def read_frames_stream(spark: SparkSession, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """Frames from a folder of Parquet files, a few files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def progressive_spectra(frames: DataFrame) -> DataFrame:
    """Spectra of arriving frames: energy axis last, rows added up, energy ascending. Without state: the same on a batch."""
    return select.flip_energy(detect.sum_y(select.unscramble_eels(frames)))


def live_virtual_images(frames: DataFrame, cy: float, cx: float, bf_radius: float, df_inner: float, df_outer: float) -> DataFrame:
    """Bright- and dark-field values of arriving frames, by Arrow batches."""
    return masked_sums(frames, {"bf": lambda y, x, h, w: select.in_disk(y, x, cy, cx, bf_radius), "df": lambda y, x, h, w: select.in_annulus(y, x, cy, cx, df_inner, df_outer)})


def first_arrivals(arrivals: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Each frame once: of frames sent again within the watermark the first stays, later ones than that are dropped.

    The state is bounded by the watermark on the arrival time ts."""
    return arrivals.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["dataset_id", "frame_idx"])


def completion_masks(arrivals: DataFrame) -> DataFrame:
    """dataset_id, bucket, mask: which frames have arrived, a bit each, 32768 in a bucket. The state is these 4 KB a bucket;
    frames that are sent again set the same bit. For output mode update."""
    at = F.col("frame_idx") + 1
    return arrivals.where("frame_idx >= 0").groupBy("dataset_id", F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("mask"))


def keep_masks(masks: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every change of streamed masks appended to a table, with its batch."""

    def append(df: DataFrame, k: int) -> None:
        df.withColumn("batch", F.lit(k).cast("long")).write.mode("append").parquet(path)

    return masks.writeStream.foreachBatch(append).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_masks(spark: SparkSession, path: str) -> DataFrame:
    """The last mask of each bucket."""
    return spark.read.parquet(path).groupBy("dataset_id", "bucket").agg(F.max_by("mask", "batch").alias("mask"))


def completion_state(masks: DataFrame, datasets: DataFrame) -> DataFrame:
    """Frames received of each data set and their percentage, from masks."""
    got = masks.groupBy("dataset_id").agg(F.sum(F.bitmap_count("mask")).alias("received"))
    return got.join(datasets.select("dataset_id", "n_frames"), "dataset_id").select("dataset_id", "received", (100 * F.col("received") / F.col("n_frames")).alias("percent"))


def region_ready(masks: DataFrame, regions: DataFrame) -> DataFrame:
    """dataset_id, region, ready: whether all frames of a region of the scan have arrived (regions: dataset_id, region, scan_w,
    y0, y1, x0, x1, ends excluded). A region is ready if no bit of it is missing in the masks; an empty one is ready."""
    rows = regions.withColumn("y", F.explode_outer(F.expr("if(y1 > y0 and x1 > x0, sequence(y0, y1 - 1), null)")))
    rows = rows.withColumn("at", F.explode_outer(F.expr("transform(if(y is null, null, sequence(x0, x1 - 1)), x -> bigint(y) * scan_w + x + 1)")))
    wanted = rows.groupBy("dataset_id", "region", F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("want"), F.count("at").alias("n"))
    both = wanted.join(masks, ["dataset_id", "bucket"], "left")
    either = both.select("dataset_id", "region", "bucket", "n", "mask", F.explode(F.array("want", F.coalesce("mask", "want"))).alias("m"))
    union = either.groupBy("dataset_id", "region", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("m")).alias("all"), F.first(F.bitmap_count("mask")).alias("had"), F.first("n").alias("n"))
    return union.groupBy("dataset_id", "region").agg(F.min((F.col("n") == 0) | F.coalesce(F.col("all") == F.col("had"), F.lit(False))).alias("ready"))


class ProgressLog(StreamingQueryListener):
    """Writes the progress of each batch of each query to a folder, a small JSON file a batch, named by the query and the batch,
    so that a query that is started again from its checkpoint goes on in the same log.

    Spark itself keeps the last batches of a running query only (spark.sql.streaming.numRecentProgressUpdates)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = {"id": str(p.id), "batch": p.batchId, "at": p.timestamp, "rows": p.numInputRows, "millis": (p.durationMs or {}).get("triggerExecution", 0)}
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p.id}-{p.batchId:010d}.json")
        out = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).create(at, True)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()

    def stop(self) -> None:
        """Wait for what has been told, and listen no more."""
        self.flush()
        self.spark.streams.removeListener(self)

    def flush(self) -> None:
        self.spark._jsc.sc().listenerBus().waitUntilEmpty()


def progress_metrics(spark: SparkSession, path: str, total_rows: int | None = None, recent: int = 20) -> DataFrame:
    """id, batches, rows, rows_per_s (of the last `recent` batches that had rows), percent of total_rows, seconds_left, from
    the log of ProgressLog."""
    steps = spark.read.schema("id string, batch long, at string, rows long, millis long").json(path).where("rows > 0")
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("batch"))) <= recent
    steps = steps.withColumn("last", last)
    pace = 1000 * F.try_divide(F.sum(F.when(F.col("last"), F.col("rows"))), F.sum(F.when(F.col("last"), F.col("millis"))))
    out = steps.groupBy("id").agg(F.count(F.lit(1)).alias("batches"), F.sum("rows").alias("rows"), pace.alias("rows_per_s"))
    total = F.lit(total_rows).cast("long")
    left = F.greatest(F.lit(0), total - F.col("rows"))
    return out.withColumns({"percent": 100 * F.col("rows") / total, "seconds_left": F.try_divide(left, F.col("rows_per_s"))})


def run_to_table(stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append") -> StreamingQuery:
    """Everything that is there now into a Parquet table; started again with the same checkpoint it goes on where it stopped."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(output_mode).trigger(availableNow=True).start()
