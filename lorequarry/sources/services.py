"""Outside services as injected functions, with a cache table before them.

Nothing here opens a connection: a caller passes a function from request to
response, and it runs on the executors for requests that the cache lacks.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorequarry.functions.text import estimate_tokens
from lorequarry.operators.costs import log_rows

ATTEMPTS, WAIT_SECONDS, PAUSE_SECONDS = 3, 3.0, 1.0
TIMEOUTS_IN_A_ROW = 2


class TooManyRequests(Exception):
    """A service's answer that asks its callers to slow down."""


def with_retries(call: Callable[[str], str], attempts: int = ATTEMPTS, wait: float = WAIT_SECONDS, pause: float = 0.0) -> Callable[[str], str | None]:
    """``call``, tried again at once, or after ``wait`` seconds where the service asks
    its callers to slow down; None when every attempt has failed.  Calls that come
    through are followed by ``pause`` seconds."""

    def tried(request: str) -> str | None:
        for left in range(attempts - 1, -1, -1):
            try:
                answer = call(request)
            except TooManyRequests:
                if left:
                    time.sleep(wait)
            except Exception:  # the service's own errors are not known here
                continue
            else:
                time.sleep(pause)
                return answer
        return None

    return tried


def until_timeouts(call: Callable[[str], str], alive: Callable[[], bool], most: int = TIMEOUTS_IN_A_ROW) -> Callable[[str], str | None]:
    """``call`` for a slow service: None for a timeout, an empty answer and any other
    error; after ``most`` timeouts in a row, or if it is not alive before the first
    call, it is not called again.  The count is kept by each task."""
    state = {"timeouts": 0, "alive": None}

    def tried(request: str) -> str | None:
        if state["alive"] is None:
            state["alive"] = alive()
        if not state["alive"] or state["timeouts"] >= most:
            return None
        try:
            answer = call(request)
        except TimeoutError:
            state["timeouts"] += 1
            return None
        except Exception:  # as above
            answer = None
        state["timeouts"] = 0
        return answer or None

    return tried


def call_service(requests: DataFrame, cache: DataFrame, call: Callable[[str], str], careful: Callable = with_retries) -> DataFrame:
    """``requests`` (``cache_key, request, ...``) with ``response`` and ``cache_hit``.

    Each distinct request that the cache (``cache_key, response``) lacks is sent
    once; a response that fails stays null.  ``careful`` wraps ``call`` for each task.
    """
    held = cache.select("cache_key", F.col("response").alias("held")).dropDuplicates(["cache_key"])
    probed = requests.join(held, "cache_key", "left")
    todo = probed.where("held is null").select("cache_key", "request").dropDuplicates(["cache_key"])
    schema = pa.schema([("cache_key", pa.string()), ("fresh", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        send = careful(call)
        for batch in batches:
            got = pa.array([send(r) for r in batch["request"].to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch["cache_key"], got], schema=schema)

    fresh = todo.mapInArrow(run, "cache_key string, fresh string")
    return probed.join(fresh, "cache_key", "left").select(
        *requests.columns, F.coalesce("held", "fresh").alias("response"), F.col("held").isNotNull().alias("cache_hit")
    )


def cache_rows(called: DataFrame, cache: DataFrame) -> DataFrame:
    """What to append to the cache: responses that it lacks."""
    return called.where("response is not null and not cache_hit").select("cache_key", "response").distinct().join(cache, "cache_key", "left_anti")


def call_log(called: DataFrame, stage: str, model: str) -> DataFrame:
    """Log rows of calls, with estimated tokens."""
    return log_rows(
        called.select(
            F.lit(stage).alias("stage"), F.lit(model).alias("model"), estimate_tokens(F.col("request")).cast("bigint").alias("input_tokens"),
            estimate_tokens(F.col("response")).cast("bigint").alias("output_tokens"), "cache_hit", F.lit(1).alias("n_items"),
        )
    )
