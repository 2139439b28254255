"""A second comparison in the style a generic harness might use: both results
through pandas, every value as text, rows sorted. Run as a script."""

from __future__ import annotations

import sys

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def main(sf_dir: str = "/root/testdata/sf0.01") -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as E

    spark = (SparkSession.builder.master("local[*]")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    print("entry rows:", len(E.entry(spark).collect()))
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    queries, sql = E.queries(), E.oracle_sql()
    for name, fn in queries.items():
        pdf = fn(spark, sf_dir).toPandas()
        ddf = con.sql(sql[name]).df()
        cols = sorted(pdf.columns)
        ok = cols == sorted(ddf.columns) and len(pdf) == len(ddf)
        if ok:
            a = pdf[cols].astype(str).sort_values(cols).reset_index(drop=True)
            b = ddf[cols].astype(str).sort_values(cols).reset_index(drop=True)
            ok = a.equals(b) and [str(t) for t in pdf[cols].dtypes] == [str(t) for t in ddf[cols].dtypes]
        bad += not ok
        if not ok:
            print("DIFF", name, dict(pdf.dtypes.astype(str)), dict(ddf.dtypes.astype(str)))
    print(f"{len(queries) - bad}/{len(queries)} equal as pandas text with equal dtypes")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(main(*sys.argv[1:]))
