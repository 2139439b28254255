"""Scale and skew check for the order and listing questions (not a registered query).

Replicates the bound sf tables ``--factor`` times with Spark (every copy gets
new keys, so group counts grow with the data), optionally gives one
restaurant a share ``--hot`` of all orders, writes both as Parquet in many
files under ``--out``, and times every order / listing question on the stored
tables. Comparing a run with ``--hot 0.33`` against one without shows
whether a hot key slows the grouped questions down.

    python tools/scale_check.py --out "$(mktemp -d /tmp/scale-XXXXXX)" --factor 40 --hot 0.33
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from tavola.plans.catalogue import CATALOGUE  # noqa: E402
from tavola.plans.listing_summary import ListingAnswers, listing_answers  # noqa: E402
from tavola.plans.summary import order_answers  # noqa: E402
from tavola.session import get_session  # noqa: E402
from tavola.sources import binding, ingest  # noqa: E402


def build(spark, sf_dir: str, out: str, factor: int, hot: float, files: int) -> None:
    copies = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("copy")
    o = binding.orders(spark, sf_dir).select("*", copies)
    hot_row = F.expr(f"pmod(hash(order_id, copy), 1000) < {int(hot * 1000)}")
    o = o.select(
        (F.col("order_id") * factor + F.col("copy")).alias("order_id"),
        F.when(hot_row, F.lit("HOT"))
         .otherwise(F.concat_ws("#", "restaurant_name", F.col("copy").cast("string")))
         .alias("restaurant_name"),
        "order_date", "order_value", "discount_used", "payment_method")
    ingest.write_table(o.repartition(files), f"{out}/orders")

    r = binding.listings(spark, sf_dir).select("*", copies)
    r = r.withColumn("name", F.concat_ws("#", "name", F.col("copy").cast("string"))).drop("copy")
    ingest.write_table(r.repartition(max(1, files // 4)), f"{out}/restaurants")


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    ap.add_argument("--out", required=True)
    ap.add_argument("--factor", type=int, default=20)
    ap.add_argument("--hot", type=float, default=0.0)
    ap.add_argument("--files", type=int, default=64)
    ap.add_argument("--cpus", type=int, default=8)
    ap.add_argument("--skip-build", action="store_true")
    args = ap.parse_args()

    spark = get_session(f"local[{args.cpus}]", app_name="tavola-scale",
                        shuffle_partitions=4 * args.cpus,
                        extra={"spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    if not args.skip_build:
        t0 = time.perf_counter()
        build(spark, args.sf_dir, args.out, args.factor, args.hot, args.files)
        print(f"# built x{args.factor} hot={args.hot} in {time.perf_counter() - t0:.1f}s", flush=True)

    r = ingest.load_listings(spark, f"{args.out}/restaurants")
    o = ingest.load_orders(spark, f"{args.out}/orders")
    n_orders = o.count()
    timings = {}
    for qid, q in CATALOGUE.items():
        df = q.run(r if q.table == "restaurants" else o)
        best = float("inf")
        for _ in range(2):
            t0 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - t0)
        timings[qid] = round(best, 3)
        print(f"{qid:28s} {best:7.3f}s", flush=True)
    t0 = time.perf_counter()
    for df in order_answers(o).all().values():
        df.write.format("noop").mode("overwrite").save()
    summary_sec = time.perf_counter() - t0
    single_sec = sum(v for k, v in timings.items() if k.startswith("oq"))
    print(f"# order questions: one by one {single_sec:.2f}s, from one summary {summary_sec:.2f}s")
    t0 = time.perf_counter()
    for df in listing_answers(r).all().values():
        df.write.format("noop").mode("overwrite").save()
    listing_summary_sec = time.perf_counter() - t0
    listing_single_sec = sum(timings[k] for k in ListingAnswers.NAMES)
    print(f"# listing questions: one by one {listing_single_sec:.2f}s, "
          f"from one summary {listing_summary_sec:.2f}s")
    print(json.dumps({"factor": args.factor, "hot": args.hot, "orders": n_orders,
                      "total_sec": round(sum(timings.values()), 3), "queries": timings,
                      "orders_single_sec": round(single_sec, 3),
                      "orders_summary_sec": round(summary_sec, 3),
                      "listings_single_sec": round(listing_single_sec, 3),
                      "listings_summary_sec": round(listing_summary_sec, 3)}))
    spark.stop()


if __name__ == "__main__":
    main()
