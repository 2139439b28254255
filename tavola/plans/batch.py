"""Answer many questions as one batch: independent Spark jobs run concurrently.

Each question is its own job (or few jobs). At small scale most of a job's
time is fixed latency with idle cores, and at large scale the cluster has
more slots than one question's stages fill. Submitting the questions from a
thread pool lets the scheduler interleave them. Every answer is written as
its own table, so no result passes through the driver.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession


def write_answers(spark: SparkSession, answers: dict[str, Callable[[], DataFrame]],
                  out_dir: str | None, max_workers: int = 4) -> dict[str, float]:
    """Run each ``answers[name]()`` and write it to ``out_dir/name`` (Parquet).

    ``out_dir=None`` executes each answer fully without storing it (the
    ``noop`` sink). Returns seconds per answer; a failure is raised after
    all submitted answers have finished.
    """
    sc = spark.sparkContext

    def run(name: str, build: Callable[[], DataFrame]) -> float:
        sc.setJobGroup(f"tavola-{name}", name, interruptOnCancel=True)
        t0 = time.perf_counter()
        df = build()
        if out_dir is None:
            df.write.format("noop").mode("overwrite").save()
        else:
            df.write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")
        return time.perf_counter() - t0

    with ThreadPoolExecutor(max_workers=max(1, max_workers)) as pool:
        futures = {name: pool.submit(run, name, build) for name, build in answers.items()}
        return {name: f.result() for name, f in futures.items()}


def write_report(spark: SparkSession, listings: DataFrame, orders: DataFrame, out_dir: str,
                 max_workers: int = 4, summary_path: str | None = None) -> dict[str, float]:
    """Every catalogued question written as ``out_dir/<id>``.

    Order questions come from one grouping-sets summary of the orders and
    twenty listing questions from one summary of the listings (materialised
    under ``summary_path``, else checkpointed); the row-level listing
    questions run on their own. All answers are submitted concurrently.
    """
    from tavola.plans.catalogue import CATALOGUE
    from tavola.plans.listing_summary import listing_answers
    from tavola.plans.summary import order_answers

    root = summary_path.rstrip("/") if summary_path else None
    from_summary = {
        **order_answers(orders, f"{root}/orders" if root else None).all(),
        **listing_answers(listings, f"{root}/listings" if root else None).all(),
    }
    answers: dict[str, Callable[[], DataFrame]] = {}
    for qid, q in CATALOGUE.items():
        if qid in from_summary:
            answers[qid] = (lambda df=from_summary[qid]: df)
        else:
            answers[qid] = (lambda run=q.run: run(listings))
    return write_answers(spark, answers, out_dir, max_workers)
