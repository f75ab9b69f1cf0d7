"""Runs of the super-resolution pipeline and their stage tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STAGES = {2: "bigft", 3: "correlations", 4: "shifts", 5: "reconstruction"}
REGISTRY = "run_id string, dataset_id string, ts timestamp, step_completed int, params map<string, string>"


class RunStore:
    """A folder with a table of runs and a folder for each stage table.

    The registry is a log: each change is a row that is appended, the latest of a run counts; nothing is rewritten."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _log(self, run_id: str, dataset_id: str, step: int, params: dict[str, str]) -> None:
        row = self.spark.createDataFrame([(run_id, dataset_id, step, params)], "run_id string, dataset_id string, step_completed int, params map<string, string>")
        row.select("run_id", "dataset_id", F.current_timestamp().alias("ts"), "step_completed", "params").write.mode("append").parquet(f"{self.folder}/runs")

    def start(self, run_id: str, dataset_id: str, params: dict[str, str]) -> None:
        self._log(run_id, dataset_id, 1, params)

    def write_stage(self, run_id: str, dataset_id: str, step: int, df: DataFrame, params: dict[str, str]) -> DataFrame:
        """Write a stage's table, note the step, and read the table back."""
        path = self.path(run_id, step)
        df.write.mode("overwrite").parquet(path)
        self._log(run_id, dataset_id, step, params)
        return self.spark.read.parquet(path)

    def path(self, run_id: str, step: int) -> str:
        return f"{self.folder}/{STAGES[step]}/run_id={run_id}"

    def runs(self) -> DataFrame:
        """The latest state of every run."""
        log = self.spark.read.schema(REGISTRY).parquet(f"{self.folder}/runs")
        last = log.groupBy("run_id").agg(F.max_by(F.struct("dataset_id", "ts", "step_completed", "params"), F.struct("ts", "step_completed")).alias("r"))
        return last.select("run_id", "r.*").where("step_completed > 0")

    def stages(self) -> DataFrame:
        """run_id, stage, size_bytes of every stage table that is there."""
        out = None
        for step, name in STAGES.items():
            try:
                files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(f"{self.folder}/{name}").select("path", "length")
            except Exception as e:  # noqa: BLE001  the stage has no folder yet
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                continue
            rows = files.select(F.regexp_extract("path", r"run_id=([^/]+)/", 1).alias("run_id"), F.lit(name).alias("stage"), F.lit(step).alias("step"), "length")
            rows = rows.groupBy("run_id", "stage", "step").agg(F.sum("length").alias("size_bytes"))
            out = rows if out is None else out.unionByName(rows)
        return out if out is not None else self.spark.createDataFrame([], "run_id string, stage string, step int, size_bytes long")

    def purge(self, condition: str, steps: tuple[int, ...] = tuple(STAGES)) -> int:
        """Remove stage tables (of the steps given) of the runs that a condition picks; the bytes that this frees.

        Runs of which all stages go are gone from runs()."""
        chosen = {r.run_id: r.dataset_id for r in self.runs().where(condition).select("run_id", "dataset_id").collect()}
        freed = 0
        jvm = self.spark.sparkContext._jvm
        for r in self.stages().where(F.col("step").isin(list(steps))).collect():
            if r.run_id in chosen:
                target = jvm.org.apache.hadoop.fs.Path(self.path(r.run_id, r.step))
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
                freed += r.size_bytes
        for run_id, dataset_id in chosen.items():
            self._log(run_id, dataset_id, 0 if set(steps) == set(STAGES) else min(steps) - 1, {})
        return freed
