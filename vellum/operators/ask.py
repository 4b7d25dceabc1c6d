"""Asking a provider: each different prompt once, answers kept in a table, failures as rows.

A provider is a Python callable, prompt -> answer, or one with batch(prompts) -> answers. Prompts are known by the SHA-256 of
their text; those that the table has an answer for aren't asked again, so a job that is run again asks only for what is
new or failed. Batches of a task are asked at once; if a batch fails, its prompts are asked one by one, and one that fails
`retries` times more is a row with its error and nothing else is lost.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

ANSWERS = "hash string, response string, error string, attempts int"
BATCH, RETRIES = 16, 2


def one_by_one(provider: Callable, prompt: str, retries: int, pause: float) -> tuple[str | None, str | None, int]:
    why = None
    for n in range(1, retries + 2):
        try:
            got = provider.batch([prompt])[0] if hasattr(provider, "batch") else provider(prompt)
            if got is None:
                raise ValueError("no answer")
            return str(got), None, n
        except Exception as e:  # whatever a provider raises is that prompt's error
            why = f"{type(e).__name__}: {e}"
            if n <= retries and pause:
                time.sleep(pause * 2 ** (n - 1))
    return None, why, retries + 1


def asked(batches: Iterator[pa.RecordBatch], provider: Callable, batch: int, retries: int, pause: float) -> Iterator[pa.RecordBatch]:
    """Rows of ANSWERS for rows (hash, prompt)."""
    for b in batches:
        for at in range(0, b.num_rows, batch):
            hashes, prompts = (b.column(i).slice(at, batch).to_pylist() for i in range(2))
            rows: list = []
            if hasattr(provider, "batch") and len(prompts) > 1:
                try:
                    got = provider.batch(prompts)
                    if len(got) == len(prompts) and all(x is not None for x in got):
                        rows = [(str(x), None, 1) for x in got]
                except Exception:  # then each by itself
                    rows = []
            rows = rows or [one_by_one(provider, p, retries, pause) for p in prompts]
            columns = list(zip(*rows, strict=True))
            kinds = [pa.string(), pa.string(), pa.int32()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(hashes, pa.string()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["hash", "response", "error", "attempts"],
            )


def kept(spark, path: str) -> DataFrame:
    """(hash, response, error) of a table of answers: an answer, if any run got one, else the last error; no table is an empty one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], "hash string, response string, error string")
    rows = spark.read.schema(ANSWERS + ", run string").parquet(path)
    best = F.min_by(F.struct("response", "error"), F.struct(F.col("response").isNull(), "run")).alias("a")
    return rows.groupBy("hash").agg(best).select("hash", "a.response", "a.error")


def ask(
    prompts: DataFrame, provider: Callable, path: str, batch: int = BATCH, retries: int = RETRIES, pause: float = 0.0, tasks: int | None = None,
) -> DataFrame:
    """prompts (any columns and prompt) with response and error; the table at path grows by what had to be asked.

    tasks: how many ask at a time. A null prompt has neither answer nor error.
    """
    spark = prompts.sparkSession
    known = prompts.withColumn("__hash", F.sha2(F.col("prompt").cast("binary"), 256))
    todo = known.where("prompt IS NOT NULL").groupBy(F.col("__hash").alias("hash")).agg(F.first("prompt").alias("prompt"))
    todo = written(todo.join(kept(spark, path).where("response IS NOT NULL").select("hash"), "hash", "left_anti"), "prompts")
    if todo.head(1):
        dealt = todo.repartition(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), "hash")
        rows = dealt.mapInArrow(lambda it: asked(it, provider, batch, retries, pause), ANSWERS)
        # runs are told apart by time, so that the last error is known
        rows.write.mode("append").parquet(f"{path.rstrip('/')}/run={time.time_ns():020d}-{uuid.uuid4().hex}")
    return known.join(kept(spark, path), known["__hash"] == F.col("hash"), "left").drop("__hash", "hash")
