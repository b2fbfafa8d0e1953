"""Answers to requests, each distinct request asked once: a table that outlives the run which asked.

A request is a JSON text and is known by its SHA-256. ask() reduces requests to distinct ones, leaves out those whose
answer is in the table (a left-anti join), has tasks call the service with a bounded number of calls in flight, and appends
the answers wave by wave. A run that is stopped loses at most the wave that it was writing; run again, it asks for what is
missing. A call that fails is a row with its error, so it takes no answer of other calls with it; ask() fails once all
others are in, and a later run asks the failed ones again. A lost executor's tasks ask their open requests again."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import importable
from lectern.sources.sinks import materialise

ANSWERS = "id string, answer string, error string"
#: Calls that a task has in flight, and requests of a wave.
IN_FLIGHT, WAVE = 8, 100_000


def request_id(request: Column | str, salt: str = "") -> Column:
    """salt names whoever answers (models, versions): other answers are other requests."""
    return F.sha2(F.concat(F.lit(f"{salt}\n"), request), 256)


def known(spark: SparkSession, path: str) -> DataFrame:
    """id, answer: the answers at path, one for each id."""
    try:
        rows = spark.read.schema(ANSWERS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = spark.createDataFrame([], ANSWERS)
    return rows.filter("error is null").groupBy("id").agg(F.min("answer").alias("answer"))


def pending(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """id, request, asked (how many rows ask it): distinct requests (id, request) without an answer (id). Rows are reduced
    within tasks before they move, so a request that a third of all rows make is a few rows."""
    distinct = requests.groupBy("id").agg(F.min("request").alias("request"), F.count(F.lit(1)).alias("asked"))
    return distinct.join(answers.select("id"), "id", "left_anti")


def _call(reply: Callable[[str], str], in_flight: int):
    schema = pa.schema([(x.split()[0], pa.string()) for x in ANSWERS.split(", ")])

    def answered(request: str) -> tuple[str | None, str | None]:
        try:
            return reply(request), None
        except Exception as e:
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(in_flight) as pool:
            open_: dict[Future, str] = {}

            def finished(until: int) -> Iterator[pa.RecordBatch]:
                while len(open_) > until:
                    done, _ = wait(open_, return_when=FIRST_COMPLETED)
                    rows = [(open_.pop(x), *x.result()) for x in done]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

            for batch in batches:
                for id_, request in zip(batch.column("id").to_pylist(), batch.column("request").to_pylist(), strict=True):
                    open_[pool.submit(answered, request)] = id_
                    yield from finished(in_flight - 1)
            yield from finished(0)

    return run


def ask(requests: DataFrame, path: str, reply: Callable[[str], str], in_flight: int = IN_FLIGHT, wave: int = WAVE) -> DataFrame:
    """id, answer: the table at path, which then answers all requests (id, request). reply is called in tasks."""
    spark = requests.sparkSession
    importable(spark)
    waiting = materialise(pending(requests.select("id", "request"), known(spark, path)).select("id", "request"), "pending")
    n = waiting.count()
    waves = math.ceil(n / wave)
    for k in range(waves):
        part = waiting if waves == 1 else waiting.filter(F.pmod(F.xxhash64("id"), F.lit(waves)) == k)
        part.mapInArrow(_call(reply, in_flight), ANSWERS).write.mode("append").parquet(path)
    if n:
        failed = spark.read.schema(ANSWERS).parquet(path).join(pending(waiting, known(spark, path)), "id", "left_semi").filter("error is not null")
        if first := failed.select("id", "error").head(1):
            raise RuntimeError(f"{failed.select('id').distinct().count()} of {n} requests failed, one with {first[0].error}; run again to ask them again")
    return known(spark, path)
