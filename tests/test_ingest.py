
from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tavola.operators import cleaning, listings, orders
from tavola.plans.catalogue import CATALOGUE
from tavola.sources import ingest, schemas

HEADER = ("name,online_order,book_table,rate,votes,location,rest_type,dish_liked,cuisines,"
          "approx_cost_for_two,listed_in(type),listed_in(city),rating_category,price_category")

CSV_ROWS = [
    '"Cafe ""X"", A",Yes,No,4.1,120,BTM,Cafe,"Pasta, Pizza","Italian, Cafe",800,Delivery,BTM,Good,Moderate',
    '"Multi\nLine",No,Yes,NA,7,N/A,Bar,,Bar Food,1200.0,Dine-out,Indiranagar,None,High',
    "Plain,Yes,Yes,3.2,0,St. John's Road,Quick Bites,nan,North Indian,300,Delivery,Koramangala,Average,Cheap",
]


def _write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_listings_csv(spark, tmp_path):
    path = _write(tmp_path, "listings.csv", HEADER + "\n" + "\n".join(CSV_ROWS) + "\n")
    df = ingest.load_listings_csv(spark, path)
    assert df.schema == schemas.LISTINGS
    rows = {r["name"]: r for r in df.collect()}
    assert set(rows) == {'Cafe "X", A', "Multi\nLine", "Plain"}
    cafe = rows['Cafe "X", A']
    assert (cafe["rate"], cafe["votes"], cafe["cuisines"], cafe["approx_cost_for_two"]) == (
        4.1, 120, "Italian, Cafe", 800)
    assert cafe["listed_type"] == "Delivery" and cafe["listed_city"] == "BTM"
    multi = rows["Multi\nLine"]
    assert multi["rate"] is None and multi["location"] is None
    assert multi["approx_cost_for_two"] == 1200 and multi["rating_category"] is None
    assert multi["dish_liked"] is None
    assert rows["Plain"]["location"] == "St. John's Road"
    assert rows["Plain"]["dish_liked"] is None


def test_orders_json_array(spark, tmp_path):
    records = [
        {"order_id": 1, "restaurant_name": "A", "order_date": "2024-01-05",
         "order_value": 250.5, "discount_used": "Yes", "payment_method": "UPI"},
        {"order_id": 2, "restaurant_name": "B", "order_date": "2024-1-5",
         "order_value": 99.0, "discount_used": "No", "payment_method": "Card"},
        {"order_id": 3, "restaurant_name": "A", "order_date": "2024-01-31T23:30:00-05:00",
         "order_value": 10, "discount_used": "maybe", "payment_method": "Cash"},
    ]
    path = _write(tmp_path, "orders.json", json.dumps(records, indent=2))
    df = ingest.load_orders_json(spark, path)
    assert df.schema == schemas.ORDERS
    got = {r["order_id"]: r for r in df.collect()}
    assert [got[i]["discount_used"] for i in (1, 2, 3)] == [1, 0, None]
    assert got[1]["order_date"] == dt.datetime(2024, 1, 5)
    assert got[2]["order_date"] is None
    assert got[3]["order_date"] == dt.datetime(2024, 2, 1, 4, 30)
    assert got[3]["order_value"] == 10.0


def test_orders_json_lines(spark, tmp_path):
    lines = "\n".join(json.dumps({"order_id": i, "restaurant_name": "R", "order_date": "2024-05-01",
                                  "order_value": 1.5, "discount_used": "No",
                                  "payment_method": "Card"}) for i in range(5))
    path = _write(tmp_path, "orders.jsonl", lines)
    df = ingest.load_orders_json(spark, path, json_lines=True)
    assert df.count() == 5


def test_run_load_writes_tables_and_report(spark, tmp_path):
    csv = _write(tmp_path, "l.csv", HEADER + "\n" + "\n".join(CSV_ROWS) + "\n")
    js = _write(tmp_path, "o.json", json.dumps([
        {"order_id": 1, "restaurant_name": "A", "order_date": "2024-01-05", "order_value": 2.0,
         "discount_used": "Yes", "payment_method": "UPI"}]))
    out = str(tmp_path / "tables")
    report = {r["table_name"]: r["row_count"] for r in ingest.run_load(spark, csv, js, out).collect()}
    assert report == {"restaurants": 3, "orders": 1}
    stored = ingest.load_listings(spark, f"{out}/restaurants")
    assert stored.schema == schemas.LISTINGS and stored.count() == 3


def test_rating_and_cost_text(spark):
    df = spark.createDataFrame([("4.1/5", "1,200"), ("4.1 /5", "800"), ("NEW", None), ("-", "abc"),
                                ("3.0/5", "800.0")],
                               "rate string, approx_cost_for_two string")
    got = [tuple(r) for r in cleaning.parse_cost(cleaning.parse_rating(df)).collect()]
    assert got == [(4.1, 1200), (4.1, 800), (None, None), (None, None), (3.0, 800)]


def test_clean_listings_pipeline(spark):
    raw = spark.createDataFrame(
        [("A", "4.1/5", "1,200", "Dine-out", "X"), ("A", "4.1/5", "1,200", "Dine-out", "X"),
         ("B", "NEW", "300", "Delivery", "Y"), ("C", "3.2/5", None, "Delivery", "Y"),
         ("D", "2.5/5", "2,500", "Delivery", "Z")],
        "name string, rate string, approx_cost_for_two string, `listed_in(type)` string, "
        "`listed_in(city)` string")
    out = cleaning.clean_listings(raw)
    assert out.schema == schemas.LISTINGS
    got = sorted((r["name"], r["rate"], r["approx_cost_for_two"], r["price_category"],
                  r["rating_category"], r["listed_type"]) for r in out.collect())
    assert got == [("A", 4.1, 1200, "High", "Good", "Dine-out"),
                   ("D", 2.5, 2500, "Very High", "Low", "Delivery")]


def test_category_cut_points(spark):
    df = spark.createDataFrame([(c, r) for c, r in [(300, 2.9), (301, 3.0), (600, 3.9), (601, 4.0),
                                                    (1000, None), (1001, 4.9), (2000, 1.8),
                                                    (2001, 3.5), (None, 3.5)]],
                               "approx_cost_for_two int, rate double")
    out = cleaning.add_rating_category(cleaning.add_price_category(df))
    got = [(r["price_category"], r["rating_category"]) for r in out.collect()]
    assert got == [("Cheap", "Low"), ("Low", "Average"), ("Low", "Average"), ("Moderate", "Good"),
                   ("Moderate", None), ("High", "Good"), ("High", "Low"), ("Very High", "Average"),
                   (None, "Average")]
    custom = cleaning.add_price_category(df, cuts=((500, "Budget"),), top="Premium")
    assert custom.where(F.col("price_category") == "Budget").count() == 2


def test_drop_duplicates_and_missing(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 1.0, 1), ("b", None, 2), ("c", 2.0, None)],
                               "name string, rate double, approx_cost_for_two int")
    assert cleaning.drop_duplicates(df).count() == 3
    assert [r["name"] for r in cleaning.drop_missing(df).collect()] == ["a", "a"]


def test_load_report_counts(spark):
    a = spark.range(3)
    b = spark.range(0)
    got = {r["table_name"]: r["row_count"] for r in ingest.load_report({"a": a, "b": b}).collect()}
    assert got == {"a": 3, "b": 0}


def _orders(*changes):
    base = {"order_id": 1, "restaurant_name": "A", "order_date": "2024-01-05", "order_value": 2.0,
            "discount_used": "Yes", "payment_method": "UPI"}
    return [base | {"order_id": i} | c for i, c in enumerate(changes)]


def test_orders_load_loses_nothing(spark, tmp_path):
    lines = "\n".join(json.dumps(r) for r in _orders({}, {}, {}, {}, {}))
    path = _write(tmp_path, "o.jsonl", lines)
    assert ingest.load_orders_json(spark, path).count() == 5          # told apart by content
    with pytest.raises(ValueError, match="JSON Lines"):
        ingest.load_orders_json(spark, path, json_lines=False)
    text = _write(tmp_path, "t.json", json.dumps(_orders({"order_value": "350.50"}, {"order_value": float("nan")})))
    got = {r["order_id"]: r["order_value"] for r in ingest.load_orders_json(spark, text).collect()}
    assert got == {0: 350.5, 1: None}


@pytest.mark.parametrize("content", [
    json.dumps(_orders({}, {}))[:-20],
    json.dumps(_orders({}, {"order_id": "ORD0001"})),
    json.dumps(_orders({}, {"order_value": "many"})),
])
def test_orders_that_cannot_be_stored_fail_the_load(spark, tmp_path, content):
    csv = _write(tmp_path, "l.csv", HEADER + "\n" + "\n".join(CSV_ROWS) + "\n")
    js = _write(tmp_path, "o.json", content)
    with pytest.raises(ValueError, match="cannot be stored"):
        ingest.run_load(spark, csv, js, str(tmp_path / "tables"))
    with pytest.raises(Exception, match="cannot be stored"):
        ingest.load_orders_json(spark, js).collect()
    report = {r["table_name"]: r["rejected_count"] for r in ingest.run_load(spark, csv, js, str(tmp_path / "tables"), max_rejected=1).collect()}
    assert report == {"restaurants": 0, "orders": 1}


def test_order_questions_answer_over_a_nan_value(spark, tmp_path):
    path = _write(tmp_path, "o.json", json.dumps(_orders({}, {"order_value": float("nan")}, {"order_value": 1e12})))
    df = ingest.load_orders_json(spark, path)
    for name, question in CATALOGUE.items():
        if question.table == "orders":
            assert question.run(df).count() >= 0, name
    assert orders.oq1_payment_value(df).first()["Max_Order_Value"] == 1e12


def test_raw_load_answers_rating_questions(spark, tmp_path):
    head = "name,online_order,book_table,rate,votes,location,rest_type,dish_liked,cuisines,approx_cost_for_two,listed_in(type),listed_in(city)"
    row = '{n},Yes,No,{r},1,L{n},Cafe,,Thai,"{c}",Delivery,X'
    rows = [row.format(n=1, r="4.1/5", c="1,200"), row.format(n=2, r="NEW", c="300"), row.format(n=3, r="3.9/5", c="1,100")]
    raw = _write(tmp_path, "raw.csv", "\n".join([head, *rows, rows[0]]) + "\n")
    js = _write(tmp_path, "o.json", json.dumps(_orders({})))
    out = str(tmp_path / "tables")
    with pytest.raises(ValueError, match="raw=True"):
        ingest.run_load(spark, raw, js, out)
    report = {r["table_name"]: r["row_count"] for r in ingest.run_load(spark, raw, js, out, raw=True, multi_line=False).collect()}
    assert report == {"restaurants": 2, "orders": 1}
    stored = ingest.load_listings(spark, f"{out}/restaurants")
    assert [r["Location"] for r in listings.q1_best_locations(stored).collect()] == ["L1", "L3"]
    assert listings.q5_price_satisfaction(stored).first()["Price_Category"] == "High"
    assert [r["Restaurant"] for r in listings.q15_top_per_price(stored).collect()] == ["1"]


def test_text_that_is_no_number(spark):
    df = spark.createDataFrame([("NaN/5", "800.7"), ("inf/5", "1,200.4"), ("4/5", "x")], "rate string, approx_cost_for_two string")
    got = [tuple(r) for r in cleaning.parse_cost(cleaning.parse_rating(df)).collect()]
    assert got == [(None, 801), (None, 1200), (4.0, None)]


def test_missing_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1.0, 2), (None, 3)], "rate double, approx_cost_for_two int").write.parquet(path)
    df = cleaning.drop_missing(spark.read.parquet(path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(rate)" in plan.split("PushedFilters")[1] and df.count() == 1


def test_a_grown_folder_is_read_in_full(spark, tmp_path):
    from tavola.sources import binding
    import shutil
    part = "/root/testdata/sf0.001/part.parquet"
    (tmp_path / "one").mkdir()
    (tmp_path / "two/part.parquet").mkdir(parents=True)
    shutil.copyfile(part, tmp_path / "one/part.parquet")
    one = binding.listings(spark, str(tmp_path / "one")).count()
    for n in ("a", "b"):
        shutil.copyfile(part, tmp_path / f"two/part.parquet/{n}.parquet")
    assert binding.listings(spark, str(tmp_path / "two")).count() == 2 * one


BAD_ROWS = [
    "Extra,Yes,Yes,3.2,0,BTM,Quick Bites,x,Thai,300,Delivery,Delivery,BTM,Average,Cheap",     # a field too many
    "Short,Yes,Yes,3.2,0,BTM,Quick Bites,x,Thai,300,Delivery,BTM",                            # two too few
    'Comma,Yes,Yes,3.2,0,BTM,Quick Bites,x,Thai,"1,200",Delivery,BTM,Average,High',
    "Word,Yes,Yes,3.2,0,BTM,Quick Bites,x,Thai,abc,Delivery,BTM,Average,High",
    "Votes,Yes,Yes,3.2,ten,BTM,Quick Bites,x,Thai,300,Delivery,BTM,Average,Cheap",
]


def test_listings_that_cannot_be_stored_fail_the_load(spark, tmp_path):
    js = _write(tmp_path, "o.json", json.dumps(_orders({})))
    for row in BAD_ROWS:
        path = _write(tmp_path, "l.csv", "\n".join([HEADER, *CSV_ROWS, row]) + "\n")
        with pytest.raises(ValueError, match="1 and .* 0 rows cannot be stored"):
            ingest.run_load(spark, path, js, str(tmp_path / "tables"))
        with pytest.raises(Exception, match="cannot be stored"):
            ingest.load_listings_csv(spark, path).collect()
    path = _write(tmp_path, "l.csv", "\n".join([HEADER, *CSV_ROWS, *BAD_ROWS]) + "\n")
    report = ingest.run_load(spark, path, js, str(tmp_path / "tables"), max_rejected=5).collect()
    assert [tuple(r) for r in report] == [("restaurants", 3, 5), ("orders", 1, 0)]
    stored = ingest.load_listings(spark, str(tmp_path / "tables/restaurants"))
    assert {r["name"] for r in stored.collect()} == {'Cafe "X", A', "Multi\nLine", "Plain"}


def test_raw_listings_count_rows_of_the_wrong_width_alone(spark, tmp_path):
    head = "name,online_order,book_table,rate,votes,location,rest_type,dish_liked,cuisines,approx_cost_for_two,listed_in(type),listed_in(city)"
    rows = ['A,Yes,No,4.1/5,1,L,Cafe,,Thai,"1,200",Delivery,X', "B,Yes,No,NEW,1,L,Cafe,,Thai,300,Delivery,X", "C,Yes,No,3.1/5,1,L,Cafe,,Thai,300,Delivery,X,more"]
    js = _write(tmp_path, "o.json", json.dumps(_orders({})))
    for multi_line in (True, False):
        path = _write(tmp_path, "raw.csv", "\n".join([head, *rows]) + "\n")
        with pytest.raises(ValueError, match="1 and"):
            ingest.run_load(spark, path, js, str(tmp_path / "tables"), raw=True, multi_line=multi_line)
        report = ingest.run_load(spark, path, js, str(tmp_path / "tables"), raw=True, multi_line=multi_line, max_rejected=1).collect()
        assert [tuple(r) for r in report] == [("restaurants", 1, 1), ("orders", 1, 0)]
    with pytest.raises(ValueError, match="header"):
        ingest.scan_listings(spark, _write(tmp_path, "none.csv", ""))


def test_files_of_another_header_fail_the_load(spark, tmp_path):
    (tmp_path / "l").mkdir()
    _write(tmp_path / "l", "a.csv", HEADER + "\n" + CSV_ROWS[2] + "\n")
    _write(tmp_path / "l", "b.csv", HEADER.replace("votes,location", "location,votes") + "\n" + CSV_ROWS[2] + "\n")
    with pytest.raises(Exception, match="header does not conform"):
        ingest.load_listings_csv(spark, str(tmp_path / "l")).collect()


def test_an_orders_folder_of_both_forms_is_read_in_full(spark, tmp_path):
    import gzip
    folder = tmp_path / "orders"
    folder.mkdir()
    many = _orders(*[{} for _ in range(50)])
    _write(folder, "array.json", "\n \t" + json.dumps(many, indent=2))
    _write(folder, "one_line.json", "\ufeff" + json.dumps(_orders({}, {})))
    _write(folder, "lines.jsonl", "\n".join(json.dumps(r) for r in _orders({}, {}, {}, {}, {})))
    (folder / "packed.json.gz").write_bytes(gzip.compress(json.dumps(_orders({}, {}, {}), indent=1).encode()))
    _write(folder, "empty.json", "")
    forms = ingest.json_forms(spark, str(folder))
    assert [len(forms[True]), len(forms[False])] == [1, 3]
    assert ingest.load_orders_json(spark, str(folder)).count() == 60
    with pytest.raises(ValueError, match="JSON Lines"):
        ingest.read_orders(spark, str(folder), json_lines=False)
    _write(folder, "other.json", "order_id\n1\n")
    with pytest.raises(ValueError, match="neither"):
        ingest.read_orders(spark, str(folder))
    assert ingest.load_orders_json(spark, _write(tmp_path, "blank.json", " \n")).count() == 0


def test_a_failed_load_leaves_the_old_pair(spark, tmp_path, monkeypatch):
    csv = _write(tmp_path, "l.csv", HEADER + "\n" + "\n".join(CSV_ROWS) + "\n")
    js = _write(tmp_path, "o.json", json.dumps(_orders({}, {})))
    out = str(tmp_path / "tables")
    ingest.run_load(spark, csv, js, out)
    read = lambda: (ingest.load_listings(spark, f"{out}/restaurants").count(), ingest.load_orders(spark, f"{out}/orders/").count())
    assert read() == (3, 2)
    fewer = _write(tmp_path, "l2.csv", HEADER + "\n" + CSV_ROWS[2] + "\n")
    write = ingest.write_table

    def failing(df, path, partition_by=None):
        if path.endswith("/orders"):
            raise RuntimeError("disk full")
        write(df, path, partition_by)

    monkeypatch.setattr(ingest, "write_table", failing)
    with pytest.raises(RuntimeError):
        ingest.run_load(spark, fewer, js, out)
    assert read() == (3, 2)
    monkeypatch.setattr(ingest, "write_table", write)
    ingest.run_load(spark, fewer, js, out)
    assert read() == (1, 2)
    write(ingest.load_orders(spark, f"{out}/orders"), str(tmp_path / "plain/orders"))  # a table without versions
    assert ingest.load_orders(spark, str(tmp_path / "plain/orders")).count() == 2
