"""tavola: marketplace analytics (restaurant listings and orders) on Spark.

Layout
------
``sources``    schemas, CSV/JSON ingest, Parquet load/store, test-table binding
``functions``  exact rounding and percentage columns shared by every query
``operators``  cleaning jobs and the named listing / explorer / order questions
``plans``      the question catalogue, the query registry and the oracle SQL

Every query is a function ``(DataFrame, params) -> DataFrame`` that builds a
lazy plan; nothing is collected to the driver.
"""

from tavola.session import get_session

__all__ = ["get_session"]
