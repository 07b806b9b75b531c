"""Batch labelling of cases by an injected callable."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from riskloom.functions import fixed_values as fv

RESULT = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("confidence_score", T.DoubleType()),
        T.StructField("processing_status", T.StringType()),
        T.StructField("error_message", T.StringType()),
    ]
)


class Throttled(Exception):
    """Raised by a labeller that wants to be called again later."""


def label_cases(
    df: DataFrame,
    labeller: Callable[[dict], dict],
    max_retries: int = 5,
    pause: Callable[[float], None] = time.sleep,
    in_flight: int = 1,
    calls_per_second: float | None = None,
) -> DataFrame:
    """Add category, confidence, status and error to each case; a failing case becomes an error row.

    Rows stream through Arrow batches, partition by partition; a task makes ``in_flight`` calls
    at a time, and begins at most ``calls_per_second`` of them, repeats included. A throttled call is
    repeated after ``min(32, 2^attempt + U)`` seconds.
    """
    schema = T.StructType([*df.schema.fields, *RESULT.fields])

    def attempt(case: dict, wait: Callable[[], None]) -> tuple:
        for n in range(max_retries + 1):
            try:
                wait()
                answer = labeller(case)
                return answer["category"], float(answer["confidence_score"]), "success", None
            except Throttled as e:
                if n == max_retries:
                    return "Insufficient_Information", 0.0, "error", str(e)
                pause(min(32.0, 2.0**n + random.random()))
            except Exception as e:  # the case fails, not the job
                return "Insufficient_Information", 0.0, "error", str(e)
        raise AssertionError("unreachable")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in RESULT.fields]
        wait = _pacer(calls_per_second, pause)
        with ThreadPoolExecutor(in_flight) as calls:
            for pdf in batches:
                answers = list(calls.map(lambda case: attempt(case, wait), pdf.to_dict("records")))
                yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(answers, columns=names)], axis=1)

    return df.mapInPandas(run, schema)


def _pacer(calls_per_second: float | None, pause: Callable[[float], None]) -> Callable[[], None]:
    """A function that returns when the next call of the task may begin."""
    if not calls_per_second:
        return lambda: None
    lock, due = Lock(), [0.0]

    def wait() -> None:
        with lock:
            now = time.monotonic()
            start = max(now, due[0])
            due[0] = start + 1.0 / calls_per_second
        if start > now:
            pause(start - now)

    return wait


def label_arriving(
    cases: DataFrame, out: str, checkpoint: str, labeller: Callable[[dict], dict], **kwargs
) -> DataFrame:
    """Label what has arrived on a stream, one finished table per micro-batch, and return all results.

    Started again after a crash, with the same folders, it goes on with the batch that was not
    finished; that batch is labelled anew and replaces what it left. How many rows a batch has is
    set at the source (``maxFilesPerTrigger``, ``maxBytesPerTrigger``).
    """

    def label(df: DataFrame, batch_id: int) -> None:
        label_cases(df, labeller, **kwargs).write.mode("overwrite").parquet(f"{out}/batch={batch_id:012d}")

    query = (
        cases.writeStream.foreachBatch(label).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    schema = T.StructType([*cases.schema.fields, *RESULT.fields])
    return cases.sparkSession.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def label_pending(df: DataFrame, done: DataFrame, key: Sequence[str], labeller, **kwargs) -> DataFrame:
    """Label only the rows that have no result yet, and return all results."""
    fresh = label_cases(df.join(done.select(*key), list(key), "left_anti"), labeller, **kwargs)
    return done.unionByName(fresh, allowMissingColumns=True)


def error_rate(df: DataFrame) -> DataFrame:
    return df.agg(F.avg((F.col("processing_status") != "success").cast("double")).alias("error_rate"))


def combined_label(claim: Column, customer: Column) -> Column:
    """The label of a claim's class (row) together with a customer action's class (column); NULL without one of them."""
    rows = F.array(*[F.array(*[F.lit(x) for x in row]) for row in fv.LABEL_COMBINATION])
    # element_at takes a NULL index into an array without NULLs for the last place
    both = claim.isNotNull() & customer.isNotNull()
    return F.when(both, F.element_at(F.element_at(rows, claim + 1), customer + 1))
