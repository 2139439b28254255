"""The command line front end over stored tables."""

from __future__ import annotations

from tavola.__main__ import main
from tavola.sources import binding, ingest
from tests.conftest import SF_SMALL


def test_cli_list_ask_explore(spark, tmp_path, capsys):
    root = str(tmp_path / "tables")
    ingest.write_table(binding.listings(spark, SF_SMALL), f"{root}/restaurants")
    ingest.write_table(binding.orders(spark, SF_SMALL), f"{root}/orders")

    main(["list"])
    assert "q15_top_per_price" in capsys.readouterr().out

    main(["ask", "oq1_payment_value", "--tables", root])
    out = capsys.readouterr().out
    assert "Payment_Method" in out and "Card" in out

    main(["explore", "--tables", root, "--location", "Brand#1", "--min-rate", "2.0"])
    out = capsys.readouterr().out
    assert "Total_Restaurants" in out and "Brand#1 " in out


def test_batch_writes_each_answer(spark, tmp_path):
    from tavola.operators import listings as L, orders as O
    from tavola.plans.batch import write_answers

    r, o = binding.listings(spark, SF_SMALL), binding.orders(spark, SF_SMALL)
    out = str(tmp_path / "answers")
    secs = write_answers(spark, {"q1": lambda: L.q1_best_locations(r),
                                 "oq5": lambda: O.oq5_payment_share(o),
                                 "q15": lambda: L.q15_top_per_price(r)}, out, max_workers=3)
    assert set(secs) == {"q1", "oq5", "q15"}
    assert spark.read.parquet(f"{out}/q1").count() == L.q1_best_locations(r).count()
    assert spark.read.parquet(f"{out}/oq5").count() == 3


def test_cli_report_writes_every_answer(spark, tmp_path):
    root = str(tmp_path / "tables")
    ingest.write_table(binding.listings(spark, SF_SMALL), f"{root}/restaurants")
    ingest.write_table(binding.orders(spark, SF_SMALL), f"{root}/orders")
    out = str(tmp_path / "answers")
    main(["report", "--tables", root, "--out", out, "--workers", "4"])
    from tavola.plans.catalogue import CATALOGUE
    from tavola.operators import orders as O

    for qid in CATALOGUE:
        assert spark.read.parquet(f"{out}/{qid}").columns
    stored = ingest.load_orders(spark, f"{root}/orders")
    assert (sorted(map(tuple, spark.read.parquet(f"{out}/oq6_most_orders").collect()))
            == sorted(map(tuple, O.oq6_most_orders(stored).collect())))


def test_filter_rejects_non_finite_bound():
    import pytest

    from tavola.operators.explore import ListingFilter

    with pytest.raises(ValueError):
        ListingFilter(min_rate=float("nan")).predicate()
