"""A log of responses that a run appends to and a later run resumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.model import RESPONSES, BackendConfig, GenerationConfig
from pathloom.operators.synth import SynthBackend, synthesize


def logged(spark: SparkSession, path: str) -> DataFrame:
    """All responses so far; none if the log does not exist."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], RESPONSES)
    return spark.read.schema(RESPONSES).parquet(path)


def resume(prompts: DataFrame, path: str, backend: SynthBackend | None = None, gen: GenerationConfig = GenerationConfig(), config: BackendConfig = BackendConfig(), batches: int = 10) -> DataFrame:
    """The responses to all prompts. Those already in the log at `path`, by draw_id and prompt, are not asked for again; new ones are appended in
    batches by hash of draw_id, so that an interruption loses one batch at most."""
    spark = prompts.sparkSession
    for b in range(batches):
        due = prompts.filter(F.pmod(F.xxhash64("draw_id"), F.lit(batches)) == b).join(logged(spark, path).select("draw_id", "prompt"), ["draw_id", "prompt"], "left_anti")
        synthesize(due, backend, gen, config).write.mode("append").parquet(path)
    return logged(spark, path).join(prompts.select("draw_id", "prompt"), ["draw_id", "prompt"], "left_semi")
