"""Command line: load the tables, list the questions, answer one, explore.

    python -m tavola load --listings listings.csv --orders orders.json --out TABLES
    python -m tavola list
    python -m tavola ask q11_premium_locations --tables TABLES
    python -m tavola explore --tables TABLES --location BTM --min-rate 4.0 --max-cost 1500
    python -m tavola report --tables TABLES --out ANSWERS

Results are shown with ``DataFrame.show`` (the first ``--rows`` rows); the
query itself runs on the cluster.
"""

from __future__ import annotations

import argparse

from tavola.operators import explore
from tavola.plans.batch import write_report
from tavola.plans.catalogue import CATALOGUE, answer
from tavola.session import get_session
from tavola.sources import ingest


def _tables(spark, root: str):
    root = root.rstrip("/")
    return (ingest.load_listings(spark, f"{root}/restaurants"),
            ingest.load_orders(spark, f"{root}/orders"))


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="python -m tavola")
    ap.add_argument("--master", default=None, help="e.g. local[8]; omit on a cluster")
    sub = ap.add_subparsers(dest="cmd", required=True)

    load = sub.add_parser("load", help="CSV + JSON -> Parquet tables")
    load.add_argument("--listings", required=True)
    load.add_argument("--orders", required=True)
    load.add_argument("--out", required=True)
    load.add_argument("--json-lines", action="store_true", default=None, help="insist on JSON Lines (default: by content)")
    load.add_argument("--raw", action="store_true", help="the listings file is raw: clean it")
    load.add_argument("--single-line-csv", action="store_true", help="no quoted newlines: split the CSV over tasks")
    load.add_argument("--max-rejected", type=int, default=0)

    sub.add_parser("list", help="list the questions")

    ask = sub.add_parser("ask", help="answer one question")
    ask.add_argument("question", choices=sorted(CATALOGUE))
    ask.add_argument("--tables", required=True)
    ask.add_argument("--rows", type=int, default=50)

    rep = sub.add_parser("report", help="write every answer as a Parquet table")
    rep.add_argument("--tables", required=True)
    rep.add_argument("--out", required=True)
    rep.add_argument("--workers", type=int, default=4)

    exp = sub.add_parser("explore", help="filter listings (E1) with the summary (E5)")
    exp.add_argument("--tables", required=True)
    for name in ("location", "rest_type", "listed_type", "online_order", "book_table",
                 "price_category"):
        exp.add_argument(f"--{name.replace('_', '-')}", default=explore.ALL)
    exp.add_argument("--min-rate", type=float, default=explore.DEFAULT_MIN_RATE)
    exp.add_argument("--max-cost", type=int, default=explore.DEFAULT_MAX_COST)
    exp.add_argument("--rows", type=int, default=50)

    args = ap.parse_args(argv)
    if args.cmd == "list":
        for q in CATALOGUE.values():
            print(f"{q.id:28s} [{q.table}] {q.question}")
        return

    spark = get_session(args.master)
    if args.cmd == "load":
        ingest.run_load(spark, args.listings, args.orders, args.out, args.json_lines,
                        raw=args.raw, multi_line=not args.single_line_csv, max_rejected=args.max_rejected).show()
    elif args.cmd == "ask":
        r, o = _tables(spark, args.tables)
        q = CATALOGUE[args.question]
        print(q.question)
        if q.business_value:
            print(f"Business value: {q.business_value}")
        answer(args.question, listings=r, orders=o).show(args.rows, truncate=False)
    elif args.cmd == "report":
        r, o = _tables(spark, args.tables)
        secs = write_report(spark, r, o, args.out, args.workers,
                            summary_path=f"{args.out.rstrip('/')}/_summaries")
        for qid, sec in secs.items():
            print(f"{qid:28s} {sec:7.2f}s")
    elif args.cmd == "explore":
        r, _ = _tables(spark, args.tables)
        flt = explore.ListingFilter(
            location=args.location, rest_type=args.rest_type, listed_type=args.listed_type,
            online_order=args.online_order, book_table=args.book_table,
            price_category=args.price_category, min_rate=args.min_rate, max_cost=args.max_cost)
        explore.e1_filter_listings(r, flt).show(args.rows, truncate=False)
        explore.e5_filter_summary(r, flt).show()


if __name__ == "__main__":
    main()
