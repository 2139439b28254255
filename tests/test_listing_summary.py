"""The one-pass listing summary gives exactly the single-question answers."""

from __future__ import annotations

import pytest

from tavola.operators import explore, listings as L
from tavola.plans.listing_summary import ListingAnswers, listing_answers
from tavola.sources import binding
from tests import frames
from tests.conftest import SF_ORACLE

NAMES = list(ListingAnswers.NAMES)


def _single(r, name):
    fn = getattr(L, name, None) or getattr(explore, name)
    return fn(r)


def _same(single, batch, name):
    assert single.columns == batch.columns, name
    assert ([(f.name, f.dataType) for f in single.schema]
            == [(f.name, f.dataType) for f in batch.schema]), name
    assert [tuple(x) for x in single.collect()] == [tuple(x) for x in batch.collect()], name


@pytest.fixture(scope="module")
def bound(spark):
    r = binding.listings(spark, SF_ORACLE)
    return r, listing_answers(r).all()


@pytest.mark.parametrize("name", NAMES)
def test_listing_summary_matches_single_questions(bound, name):
    r, answers = bound
    _same(_single(r, name), answers[name], name)


def test_listing_summary_on_edge_rows(spark, tmp_path):
    rows = ([{"location": None, "rate": 4.5, "approx_cost_for_two": None}]
            + [{"location": "Lone", "rate": None, "cuisines": "Unrated"}] * 3
            + [{"location": "Prem", "rate": v, "approx_cost_for_two": c, "online_order": o}
               for v, c, o in [(3.99, 1200, "Yes"), (4.0, 2500, "No"), (4.0, 1600, "yes")] * 2]
            + [{"location": "Prem", "rate": 4.1, "approx_cost_for_two": None}]
            + [{"rate": v, "approx_cost_for_two": c, "cuisines": "Mixed"}
               for v, c in [(2.9, 300), (3.0, 301), (3.5, 700), (4.9, 701), (1.8, 1500), (4.2, 1501)]])
    r = frames.listings(spark, rows)
    answers = listing_answers(r, path=str(tmp_path / "summary")).all()
    for name in NAMES:
        _same(_single(r, name), answers[name], name)


def test_listing_summary_custom_premium_tiers(spark):
    rows = [{"location": "A", "rate": 4.5, "approx_cost_for_two": c} for c in (100, 200, 250, 280, 290)]
    r = frames.listings(spark, rows)
    got = listing_answers(r, premium_categories=("Cheap",)).q11_premium_locations()
    _same(L.q11_premium_locations(r, categories=("Cheap",)), got, "q11 custom tiers")
    assert got.count() == 1
