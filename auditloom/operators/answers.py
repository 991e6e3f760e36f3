"""A store of a model's answers, so that a run that dies asks for nothing again that it has an answer to.

A request is known by the digest of what it says. Requests that the store has no answer to go out in waves of bounded
size, and each task's answers stay in the store as soon as that task is done, whatever becomes of the run. Calls that
fail or take too long leave an error instead of an answer; the next run asks for these again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from concurrent.futures import TimeoutError as TookTooLong

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..folders import exists, new_folder, saved

BATCH, TRIES, SECONDS = 20, 3, 200
#: Calls at once over all executors, and requests of a task: what a lost task may have to ask again.
CALLS_AT_ONCE, TASK_REQUESTS = 20, 500
SAID = ("system", "prompt", "settings")
STORE = "digest string, content string, error string"


def digest(said: tuple[str, ...] = SAID) -> Column:
    """What a request is known by."""
    return F.sha2(F.to_json(F.struct(*said)), 256)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(digest, content, error): one row for each request asked so far; the error is null where there is an answer."""
    rows = spark.read.schema(STORE).parquet(path) if exists(spark, path) else spark.createDataFrame([], STORE)
    best = rows.groupBy("digest").agg(F.min("content").alias("content"), F.max("error").alias("error"))
    return best.withColumn("error", F.when(F.col("content").isNull(), F.col("error")))


def _asked(fn: Callable[[pd.DataFrame], list[str]], part: pd.DataFrame, tries: int, seconds: float) -> tuple[list, str | None]:
    error = None
    for _ in range(tries):
        pool = ThreadPoolExecutor(1)
        try:
            return list(pool.submit(fn, part).result(seconds)), None
        except TookTooLong:
            error = f"took over {seconds} s"
        except Exception as e:  # the user's callable may fail in any way
            error = f"{type(e).__name__}: {e}"
        finally:
            pool.shutdown(wait=False)
    return [None] * len(part), error


def ask(
    requests: DataFrame, fn: Callable[[pd.DataFrame], list[str]], store: str, said: tuple[str, ...] = SAID, batch: int = BATCH, tries: int = TRIES,
    seconds: float = SECONDS, calls_at_once: int = CALLS_AT_ONCE, task_requests: int = TASK_REQUESTS,
) -> None:
    """Puts answers to all requests that `store` has none to. Equal requests are asked once. `fn` gets batches of request rows and gives a text or None for each."""
    spark = requests.sparkSession
    done = read_store(spark, store).filter("content is not null").select("digest")
    left = requests.withColumn("digest", digest(said)).dropDuplicates(["digest"]).join(done, "digest", "left_anti")
    left = saved(left)
    n = left.count()
    if not n:
        return
    waves = -(-n // (calls_at_once * task_requests))
    dealt = left if waves == 1 else _in_waves(left, waves)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), batch):
                part = f.iloc[k : k + batch]
                content, error = _asked(fn, part, tries, seconds)
                yield pd.DataFrame({"digest": part["digest"].array, "content": content, "error": [error] * len(part)}, columns=["digest", "content", "error"])

    for wave in range(waves):  # as many as the bounds on calls and tasks ask for
        mine = (dealt if waves == 1 else dealt.filter(F.col("wave") == wave).drop("wave")).repartition(min(calls_at_once, -(-n // batch)))
        # This version of the committer leaves the files of each task that is done, also where others fail.
        mine.mapInPandas(run, STORE).write.mode("append").option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(store)


def _in_waves(left: DataFrame, waves: int) -> DataFrame:
    """A table with a folder for each wave."""
    path = new_folder(left.sparkSession)
    left.withColumn("wave", F.pmod(F.xxhash64("digest"), F.lit(waves)).cast("int")).write.partitionBy("wave").parquet(path)
    return left.sparkSession.read.parquet(path)


def answered(requests: DataFrame, store: str, said: tuple[str, ...] = SAID, keep: tuple[str, ...] | None = None) -> DataFrame:
    """Requests (or what `keep` names of them) with content and error from the store."""
    rows = requests.withColumn("_digest", digest(said)).select(*(keep or requests.columns), "_digest")
    # Saved, so that the join below shuffles both sides, and a request that very many rows make can be split.
    known = saved(read_store(requests.sparkSession, store).withColumnRenamed("digest", "_known"))
    return rows.join(known, F.col("_digest") == F.col("_known"), "left").drop("_digest", "_known")
