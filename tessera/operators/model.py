"""The model as a stage of a plan: a cache of replies, budgets that grow, one handle a worker.

The model itself is outside: ``opener`` makes a handle, a function of (rows, budget) that returns a reply for each row, None or blank where it has none. A handle is made once in
each Python worker and name, and is kept for its tasks. Requests are split by the cache; of those that it lacks each key is asked once, however many rows have it, and only
what the first budget failed at goes on to the next. What a budget brought is written before the next one starts, so no later stage asks again; a task that is lost
with its worker asks its own rows again. Replies are put in the cache, a ``Store`` by key, as one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.sources import discard, written
from tessera.sources.store import Store

# Token budgets of the attempts to get a reply.
BUDGETS = (1024, 1536, 2048)
#: What the cache keeps of a reply.
CACHED = "key string, reply string, budget int, nbytes long, ts timestamp"
REPLY = "key string, reply string, budget int, problem string"
#: Rows that the model is given at a time.
ROWS = 64

Model = Callable[[list[dict], int], Sequence[str | None]]


def cache(spark: SparkSession, folder: str) -> Store:
    return Store(spark, folder, CACHED, ["key"])


def handle(opener: Callable[[], Model], name: str) -> Model:
    """The worker's handle of that name. It is kept in the interpreter, as functions come to the workers by value and have no module to keep it in."""
    import sys

    held = sys.__dict__.setdefault("_tessera_handles", {})
    if name not in held:
        held[name] = opener()
    return held[name]


def asking(opener: Callable[[], Model], name: str, budget: int):
    """Map: a reply for each request. What the model fails at as a batch it is given row by row, and a row that it fails at has the error as its problem."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = handle(opener, name)
        for batch in batches:
            for a in range(0, len(batch), ROWS):
                rows = batch.slice(a, ROWS).to_pylist()
                problems: list[str | None] = [None] * len(rows)
                try:
                    replies = list(model(rows, budget))
                except Exception:
                    replies = []
                    for i, row in enumerate(rows):
                        try:
                            replies += model([row], budget)
                        except Exception as e:  # noqa: BLE001  whatever a model raises is that row's problem
                            replies.append(None)
                            problems[i] = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["key"] for r in rows], pa.string()), pa.array(replies, pa.string()), pa.array([budget] * len(rows), pa.int32()), pa.array(problems, pa.string())], ["key", "reply", "budget", "problem"]
                )

    return run


def ladder(requests: DataFrame, opener: Callable[[], Model], name: str, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """Requests (key, and whatever the model reads), a key once. The reply of the first budget that has one; of a key that none has the last attempt. Null keys are not asked."""
    spark = requests.sparkSession
    rest = [c for c in requests.columns if c != "key"]
    one = requests.where("key IS NOT NULL").groupBy("key").agg(F.min(F.struct(*rest)).alias("r")).select("key", "r.*") if rest else requests.where("key IS NOT NULL").distinct()
    pending = written(one)
    out = []
    for i, budget in enumerate(budgets):
        said = written(pending.mapInArrow(asking(opener, name, budget), REPLY))
        good = T.strip(F.coalesce("reply", F.lit(""))) != ""
        out.append(said if i == len(budgets) - 1 else said.where(good))
        if i < len(budgets) - 1:
            before, pending = pending, written(pending.join(said.where(~good).select("key"), "key", "left_semi"))
            discard(before)
            if pending.isEmpty():
                break
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], REPLY)


def ask(requests: DataFrame, opener: Callable[[], Model], name: str, known: Store, budgets: Sequence[int] = BUDGETS) -> DataFrame:
    """(key, reply, budget, problem, cached) for each distinct key of the requests. New replies that are not blank go into the cache; failures do not, and are asked again another time."""
    have = known.read().select("key", "reply", "budget")
    misses = requests.join(have.select("key"), "key", "left_anti")
    batches = known.batches()
    # Written, as the cache is about to change.
    hits = written(have.join(requests.select("key").distinct(), "key", "left_semi"))
    new = written(ladder(misses, opener, name, budgets))
    fresh = new.where(T.strip(F.coalesce("reply", F.lit(""))) != "")
    known.put(batches[-1] + 1 if batches else 0, fresh.select("key", "reply", "budget", F.octet_length("reply").cast("long").alias("nbytes"), F.current_timestamp().alias("ts")))
    known.compact()
    old = hits.select("key", "reply", "budget", F.lit(None).cast("string").alias("problem"), F.lit(True).alias("cached"))
    return old.unionByName(new.withColumn("cached", F.lit(False)))


def stage(opener: Callable[[], Model], name: str, known: Store, key: Column, given: dict[str, Column], budgets: Sequence[int] = BUDGETS) -> Callable[[DataFrame], DataFrame]:
    """A model for ``classify.classify`` and ``analysis.analyse``: a function from a frame to the frame with ``reply``. ``key`` names what is asked, by content; ``given`` is what the model reads."""

    def run(df: DataFrame) -> DataFrame:
        rows = df.withColumn("key_", key)
        replies = ask(rows.select(F.col("key_").alias("key"), *[c.alias(n) for n, c in given.items()]), opener, name, known, budgets)
        return rows.join(replies.select(F.col("key").alias("key_"), "reply"), "key_", "left").drop("key_")

    return run
