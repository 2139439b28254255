"""Schemas, file ingest, Parquet tables and the test-table binding."""
