"""External completion of request texts, with a response cache."""

from collections.abc import Callable

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.functions.responses import request_key
from sightline.session import materialise

# A completion function: (prompt, max_tokens, timeout_seconds) -> response text.
Complete = Callable[[str, int, int], str]

_ANSWERS = "request_key STRING, response STRING, error STRING"


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct requests without a stored response."""
    return requests.dropDuplicates(["request_key"]).join(cache, "request_key", "left_anti")


def with_keys(requests: DataFrame, model: str) -> DataFrame:
    return requests.withColumn("request_key", request_key(model, F.col("prompt")))


def _answer(complete: Complete):
    def run(batches):
        for batch in batches:
            out = []
            for key, prompt, tokens, seconds in zip(
                batch["request_key"], batch["prompt"], batch["max_tokens"], batch["timeout_seconds"]
            ):
                try:
                    text = complete(prompt, int(tokens), int(seconds))
                    if not text or not text.strip():
                        raise ValueError("empty response")
                    out.append((key, text, None))
                except Exception as exc:  # a failed call is a result, not a failed task
                    out.append((key, None, f"{type(exc).__name__}: {exc}"))
            yield pd.DataFrame(out, columns=["request_key", "response", "error"], dtype=object)

    return run


def complete_requests(
    requests: DataFrame, complete: Complete, model: str, cache_path: str | None = None, tasks: int | None = None
) -> DataFrame:
    """Add ``response`` and ``error`` to requests ``(…, prompt, max_tokens, timeout_seconds)``.

    Requests are written first, so the answers belong to exactly these prompts.
    Equal requests are sent once.  Answers are written before use, so a lost
    executor does not send them again; with ``cache_path`` the good ones are
    kept for later runs.
    """
    spark = requests.sparkSession
    keyed = materialise(with_keys(requests, model), "requests")
    open_requests = keyed.select("request_key", "prompt", "max_tokens", "timeout_seconds")
    stored = _read_cache(spark, cache_path)
    misses = (
        open_requests.dropDuplicates(["request_key"]) if stored is None else cache_misses(open_requests, stored)
    )
    tasks = tasks or spark.sparkContext.defaultParallelism
    fresh = misses.repartition(tasks, "request_key").mapInPandas(_answer(complete), _ANSWERS)
    answers = materialise(fresh, "answers")
    if cache_path is not None:
        answers.filter("error IS NULL").select("request_key", "response").write.mode("append").parquet(cache_path)
    if stored is not None:
        answers = answers.unionByName(stored.withColumn("error", F.lit(None).cast("string")))
    return keyed.join(answers, "request_key", "left")


def _read_cache(spark, cache_path: str | None) -> DataFrame | None:
    """The cache as written by earlier calls; two calls may have stored the same key."""
    if cache_path is None:
        return None
    try:
        cache = spark.read.schema("request_key STRING, response STRING").parquet(cache_path)
    except AnalysisException:  # nothing stored yet
        return None
    # Pinned before the append above, which must not change what this run reads.
    return materialise(cache.groupBy("request_key").agg(F.min("response").alias("response")), "cache")
