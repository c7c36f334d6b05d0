"""Many clients on one session: each is a thread whose jobs are in a scheduler pool of its own, so that FAIR scheduling shares the cluster among them."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A question: its kind and a function of the session that returns its rows.
Question = tuple[str, Callable[[SparkSession], DataFrame]]
MEASURED = "clients int, client int, at int, kind string, ms double, rows long, error string"


def run_clients(spark: SparkSession, shares: Sequence[Sequence[Question]]) -> tuple[list[tuple], float]:
    """Each client asks its questions one after another, all clients at once. (A row (clients, client, at, kind, ms, rows, error) of each question, seconds
    that all took.) Rows are counted where they are. A question that fails is a row with its error, and its client goes on."""
    done: list[list[tuple]] = [[] for _ in shares]

    def client(k: int) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"client-{k}")
        for at, (kind, ask) in enumerate(shares[k]):
            began, rows, error = time.perf_counter(), None, None
            try:
                rows = ask(spark).agg(F.count(F.lit(1))).first()[0]
            except Exception as e:  # noqa: BLE001 - any failure of one question is a result of the run
                error = f"{type(e).__name__}: {e}"[:300]
            done[k].append((len(shares), k, at, kind, (time.perf_counter() - began) * 1000, rows, error))

    began = time.perf_counter()
    threads = [InheritableThread(target=client, args=(k,)) for k in range(len(shares))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return [row for own in done for row in own], time.perf_counter() - began


def dealt(questions: Sequence[Question], clients: int) -> list[list[Question]]:
    """Questions to clients in turn."""
    return [list(questions[k::clients]) for k in range(clients)]


def measured(spark: SparkSession, questions: Sequence[Question], levels: Sequence[int] = (1, 4, 16)) -> tuple[DataFrame, DataFrame]:
    """The same questions by so many clients at once, level by level: (a row for each question, (clients, seconds, answered, per_second))."""
    rows, levels_ = [], []
    for n in levels:
        own, seconds = run_clients(spark, dealt(questions, n))
        good = sum(r[6] is None for r in own)
        rows += own
        levels_.append((n, seconds, good, good / seconds if seconds else 0.0))
    return spark.createDataFrame(rows, MEASURED), spark.createDataFrame(levels_, "clients int, seconds double, answered long, per_second double")


def same_as_alone(questions: DataFrame) -> DataFrame:
    """(clients, kind, n, rows, failed) of what each level returned; rows must not depend on the number of clients."""
    return questions.groupBy("clients", "kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.count("error").alias("failed"))
