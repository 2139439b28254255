"""The one-pass order summary gives exactly the single-question answers."""

from __future__ import annotations

import datetime as dt

import pytest

from tavola.operators import orders as O
from tavola.plans.summary import order_answers
from tavola.sources import binding
from tests import frames
from tests.conftest import SF_ORACLE

NAMES = ["oq0_orders_overview", "oq1_payment_value", "oq2_top_revenue", "oq3_discount_share",
         "oq4_discount_value", "oq5_payment_share", "oq6_most_orders", "oq7_monthly_revenue",
         "oq8_top_avg_value", "oq9_discount_split_top10", "oq10_discount_impact"]

# questions whose row order is fully defined (OQ3 has no ORDER BY)
ORDERED = set(NAMES) - {"oq3_discount_share"}


def _same(single, batch, name):
    a, b = single.collect(), batch.collect()
    assert single.columns == batch.columns, name
    assert ([(f.name, f.dataType) for f in single.schema]
            == [(f.name, f.dataType) for f in batch.schema]), name
    if name in ORDERED:
        assert [tuple(r) for r in a] == [tuple(r) for r in b], name
    else:
        assert sorted(map(repr, a)) == sorted(map(repr, b)), name


@pytest.fixture(scope="module")
def bound_answers(spark):
    o = binding.orders(spark, SF_ORACLE)
    return o, order_answers(o).all()


@pytest.mark.parametrize("name", NAMES)
def test_summary_matches_single_questions(bound_answers, name):
    o, answers = bound_answers
    _same(getattr(O, name)(o), answers[name], name)


def test_summary_on_edge_rows(spark, tmp_path):
    rows = ([{"restaurant_name": None, "discount_used": d} for d in (1, 0, None, 1, 1)]
            + [{"restaurant_name": "A", "order_value": 1.005, "discount_used": None,
                "order_date": None}] * 3
            + [{"restaurant_name": "B", "order_value": 0.1, "payment_method": "UPI"}] * 2)
    o = frames.orders(spark, rows)
    answers = order_answers(o, path=str(tmp_path / "summary")).all()
    for name in NAMES:
        _same(getattr(O, name)(o), answers[name], name)


def test_summary_on_empty_orders(spark):
    o = frames.orders(spark, [{"order_date": dt.datetime(2024, 1, 1)}]).limit(0)
    answers = order_answers(o).all()
    assert [tuple(r) for r in answers["oq0_orders_overview"].collect()] == [(0, None, None, 0, None)]
    assert answers["oq3_discount_share"].collect() == []
