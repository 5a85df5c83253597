"""Calls of outside services from within tasks: retries with waits, hedges, bounded concurrency, replies in the
order of the rows. A service is any function of a request that returns a reply or raises."""

from __future__ import annotations

import random
import re
import time
from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from quern.operators.runs import RETRYABLE


@dataclass(frozen=True)
class Policy:
    """retry: which errors ("Name: message") are tried again; waits: seconds before each new try, with up to a share of
    `jitter` more, so that tasks don't meet again at the same time; hedge_after: seconds after which a request
    that has no reply is sent once more, and the first reply counts (None: never)."""

    retry: str
    waits: tuple[float, ...] = ()
    jitter: float = 0.0
    hedge_after: float | None = None


#: An embedder waits for its quota; a reranker tries once more at once, and hedges.
EMBEDDER = Policy(RETRYABLE["embedder"], (2, 8, 20, 40), 0.25)
RERANKER = Policy(RETRYABLE["reranker"], (0,), hedge_after=1.5)


class Client:
    """A service under a policy. sleep and draw (a number from 0 to 1) are replaced in tests."""

    def __init__(self, service: Callable[[Any], Any], policy: Policy, workers: int = 8, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random):
        self.service, self.policy, self.sleep, self.draw = service, policy, sleep, draw
        self.pool = ThreadPoolExecutor(max(2, workers)) if policy.hedge_after is not None else None

    def __call__(self, request: Any) -> Any:
        for pause in (*self.policy.waits, None):
            try:
                return self.service(request) if self.pool is None else self._hedged(request)
            except Exception as error:
                if pause is None or not re.search(self.policy.retry, f"{type(error).__name__}: {error}"):
                    raise
                self.sleep(pause + pause * self.policy.jitter * self.draw())

    def _hedged(self, request: Any) -> Any:
        """One request, and a second one if the first is slow or fails; it has failed when both have."""
        open_: set[Future] = {self.pool.submit(self.service, request)}
        second, failed = False, None
        while True:
            done, open_ = wait(open_, None if second else self.policy.hedge_after, FIRST_COMPLETED)
            for future in done:
                if (failed := future.exception()) is None:
                    return future.result()
            if not second:
                second = True
                open_.add(self.pool.submit(self.service, request))
            elif not open_:
                raise failed

    def close(self) -> None:
        if self.pool is not None:
            self.pool.shutdown(wait=False, cancel_futures=True)


def called(rows: DataFrame, request: Column, make: Callable[[], Client], reply: str, at_once: int = 8) -> DataFrame:
    """rows with `reply` (of that type) and `error`: what the client that `make` makes, one in each task, says to the
    request of each row. At most at_once requests of a task are under way, and replies come in the order
    of the rows. A request that fails for good has no reply and its error, the others go on; a null
    request isn't sent."""
    spark_schema = StructType([*rows.schema.fields, *StructType.fromDDL(f"reply {reply}, error string").fields])
    schema = to_arrow_schema(spark_schema)
    asked = rows.select("*", request.alias("_request"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = make()
        pool, under_way = ThreadPoolExecutor(at_once), deque()

        def ended() -> pa.RecordBatch:
            row, future = under_way.popleft()
            error = future.exception() if future is not None else None
            said = future.result() if future is not None and error is None else None
            told = f"{type(error).__name__}: {error}" if error is not None else None
            return pa.RecordBatch.from_pylist([row | {"reply": said, "error": told}], schema)

        try:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    for row in batch.slice(at, 64).to_pylist():
                        wanted = row.pop("_request")
                        if len(under_way) >= at_once:
                            yield ended()
                        under_way.append((row, pool.submit(client, wanted) if wanted is not None else None))
            while under_way:
                yield ended()
        finally:
            pool.shutdown(wait=False, cancel_futures=True)
            client.close()

    return asked.mapInArrow(run, spark_schema)


def reranked(rows: DataFrame, make: Callable[[], Client], at_once: int = 8) -> DataFrame:
    """rows (query_id, question, place, title, text), a bounded pool for each query: (query_id, place, score,
    error): one request {question, records} for a query, whose reply is a score for each record. If it fails, or
    says another number of scores, there are none: the order of places stands."""
    record = F.struct("place", "title", "text")
    asked = rows.groupBy("query_id").agg(F.first("question").alias("question"), F.array_sort(F.collect_list(record)).alias("r"))
    asked = asked.withColumn("places", F.transform("r", lambda x: x["place"]))
    records = F.transform("r", lambda x: F.struct(x["title"].alias("title"), x["text"].alias("text")))
    said = called(asked.select("query_id", "places", "question", records.alias("records")), F.struct("question", "records"), make, "array<double>", at_once)
    whole = F.when(F.size("reply") == F.size("places"), F.col("reply"))
    at = said.select("query_id", "error", whole.alias("scores"), F.posexplode("places").alias("i", "place"))
    return at.select("query_id", "place", F.get("scores", F.col("i")).alias("score"), "error")
