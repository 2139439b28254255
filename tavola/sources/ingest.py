"""Sources and sinks: listings CSV, orders JSON, Parquet tables.

Both readers read text with an explicit layout and keep what of a row does not
fit it. A row that cannot be stored as it is (a field too many or too few,
unreadable JSON, a number that is none) is counted, and fails the load beyond
``max_rejected``; none is shifted, padded or made NULL without a word.

Splitting: a CSV read with ``multi_line=True`` (needed for quoted newlines)
and a JSON file that is one array are each read by a single task per file.
Large inputs should therefore arrive as many files, as a CSV without quoted
newlines (``multi_line=False``) or as JSON Lines, which Spark splits freely. Ingest converts them to
Parquet once; every query reads Parquet.

The load job writes both tables to a folder of its own and then switches one
small file, ``CURRENT``, to it: readers see the old pair or the new one.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tavola.functions.sql import finite_sql, sql_string, whole_number_sql
from tavola.sources import schemas

# Text the listings reader treats as missing. This is the
# default missing-value token list of pandas.read_csv, which produced the
# stored tables.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# Bracketed listing columns and their SQL-friendly names.
RENAMES = {"listed_in(type)": "listed_type", "listed_in(city)": "listed_city"}

# The discount flag in the orders file and its stored code.
DISCOUNT_CODES = {"Yes": 1, "No": 0}

#: Listing columns that are numbers once cleaned.
_NUMBERS = ("rate", "votes", "approx_cost_for_two")

#: Bytes skipped before a JSON file's first mark (white space, byte-order mark), and at most so many of them.
_BLANK_BYTES = frozenset(b" \t\r\n\xef\xbb\xbf")
_HEAD_BYTES = 1 << 16

#: The file that names the current pair of tables, and the folder of all pairs.
CURRENT, VERSIONS = "_current_tables", "_versions"


def _null_tokens_sql(name: str) -> str:
    tokens = ", ".join(sql_string(t) for t in NULL_TOKENS)
    return f"CASE WHEN `{name}` IN ({tokens}) THEN CAST(NULL AS STRING) ELSE `{name}` END AS `{name}`"


def discount_code_sql(c: str) -> str:
    """SQL for I4: ``Yes`` -> 1, ``No`` -> 0, anything else -> NULL (int)."""
    yes, no = DISCOUNT_CODES["Yes"], DISCOUNT_CODES["No"]
    return (f"CAST(CASE WHEN CAST({c} AS STRING) = 'Yes' THEN {yes} "
            f"WHEN CAST({c} AS STRING) = 'No' THEN {no} END AS INT)")


def order_date_sql(c: str) -> str:
    """SQL for the order date: text -> TIMESTAMP_NTZ in UTC; text not
    starting ``YYYY-MM-DD`` -> NULL. Offsets such as ``-05:00`` are
    normalised to UTC (needs the UTC session zone)."""
    s = f"trim(CAST({c} AS STRING))"
    return (f"CAST(CASE WHEN {s} RLIKE '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}' "
            f"THEN try_to_timestamp({s}) END AS TIMESTAMP_NTZ)")


def scan_listings(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Scan a listings CSV with a header row, malformed rows included.

    All fields are read as text (no inference), quoted fields may hold commas,
    doubled quotes and newlines, and missing-value tokens become NULL. Column
    ``schemas.CORRUPT`` holds the text of a row that has not one field for each
    name of the header. All files must have the same header.
    """
    reader = (spark.read
              .option("header", True)
              .option("inferSchema", False)
              .option("multiLine", multi_line)
              .option("quote", '"')
              .option("escape", '"')
              .option("nullValue", "")
              .option("mode", "PERMISSIVE")
              .option("enforceSchema", False)
              .option("columnPruning", False)  # a row's fields are counted whatever columns are asked for
              .option("columnNameOfCorruptRecord", schemas.CORRUPT))
    names = reader.csv(path).columns
    if not names:
        raise ValueError(f"{path}: no header row")
    layout = StructType([StructField(n, StringType()) for n in [*names, schemas.CORRUPT]])
    return reader.schema(layout).csv(path).selectExpr(*[_null_tokens_sql(c) for c in names], schemas.CORRUPT)


def rejected_listing_sql(columns: list[str], raw: bool = False) -> str:
    """SQL for a listings row that cannot be stored: a field too many or too few or, unless the file is
    ``raw`` (C1 and C2 say what its text means), a rating, vote count or cost that is no number."""
    bad = [f"{schemas.CORRUPT} IS NOT NULL"]
    if not raw:
        bad += [f"(`{c}` IS NOT NULL AND try_cast(trim(`{c}`) AS DOUBLE) IS NULL)" for c in _NUMBERS if c in columns]
    return "(" + " OR ".join(bad) + ")"


def _stored(rows: DataFrame, rejected: str, shown: str, what: str, reject: bool) -> DataFrame:
    """``rows`` without those that cannot be stored if ``reject``; otherwise the job fails at the first."""
    fail = f"raise_error(concat({sql_string(what)}, ': row cannot be stored: ', {shown}))"
    return rows.where(f"NOT {rejected}" if reject else f"CASE WHEN {rejected} THEN CAST({fail} AS BOOLEAN) ELSE true END")


def _listing_rows(rows: DataFrame, raw: bool, reject: bool) -> DataFrame:
    shown = ", ".join(f"`{c}`" for c in [schemas.CORRUPT, *[n for n in _NUMBERS if n in rows.columns]])
    return _stored(rows, rejected_listing_sql(rows.columns, raw), f"concat_ws(' | ', {shown})", "listings file", reject).drop(schemas.CORRUPT)


def read_listings(spark: SparkSession, path: str, multi_line: bool = True, reject: bool = False) -> DataFrame:
    """The rows of a listings CSV as text. The job fails at a malformed one, or leaves it out with ``reject``."""
    return _listing_rows(scan_listings(spark, path, multi_line), True, reject)


def normalise_columns(df: DataFrame) -> DataFrame:
    """Rename ``listed_in(type)`` / ``listed_in(city)``."""
    present = {k: v for k, v in RENAMES.items() if k in df.columns}
    return df.withColumnsRenamed(present) if present else df


def to_listings_schema(df: DataFrame) -> DataFrame:
    """Cast a renamed listings frame to the LISTINGS schema; absent columns are NULL.

    Only columns of another type are converted. A rating that is NaN or infinite is NULL.
    """
    types = dict(df.dtypes)
    out = []
    for field in schemas.LISTINGS.fields:
        c = f"`{field.name}`" if field.name in types else "NULL"
        same = types.get(field.name) == field.dataType.simpleString()
        if field.name == "rate":
            e = finite_sql(c if same else f"try_cast(trim(CAST({c} AS STRING)) AS DOUBLE)")
        elif same:
            e = c
        elif field.name in ("votes", "approx_cost_for_two"):
            e = whole_number_sql(f"trim(CAST({c} AS STRING))")
        else:
            e = f"CAST({c} AS {field.dataType.simpleString()})"
        out.append(f"{e} AS `{field.name}`")
    return df.selectExpr(*out)


def load_listings_csv(spark: SparkSession, path: str, multi_line: bool = True, reject: bool = False) -> DataFrame:
    """I1 + I2: a cleaned listings CSV as a LISTINGS-shaped frame.

    Fails for a file that is not cleaned (category columns absent) and at a row
    that cannot be stored; with ``reject`` such rows are left out.
    """
    df = normalise_columns(_listing_rows(scan_listings(spark, path, multi_line), False, reject))
    absent = sorted({"rate", "approx_cost_for_two", "price_category", "rating_category"} - set(df.columns))
    if absent:
        raise ValueError(f"{path}: no column {', '.join(absent)}; a raw listings file is loaded with raw=True")
    return to_listings_schema(df)


def _first_mark(spark: SparkSession, file: str) -> str:
    """The first character of a file that is no white space, '' for none; read from its first bytes alone."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
    stream = where.getFileSystem(conf).open(where)
    try:
        codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(where)
        text = codec.createInputStream(stream) if codec is not None else stream
        for _ in range(_HEAD_BYTES):
            byte = text.read()
            if byte < 0:
                return ""
            if byte not in _BLANK_BYTES:
                return chr(byte)
    finally:
        stream.close()
    raise ValueError(f"{file}: begins with {_HEAD_BYTES} blank bytes")


def json_forms(spark: SparkSession, path: str) -> dict[bool, list[str]]:
    """The files of an orders folder (or the one file): under True those that hold a record per
    line, under False those that hold one array. Each file's first bytes tell its form."""
    files = spark.read.text(path).inputFiles()
    with ThreadPoolExecutor(16) as pool:
        marks = list(pool.map(lambda f: _first_mark(spark, f), files))
    forms: dict[bool, list[str]] = {True: [], False: []}
    for file, mark in zip(files, marks):
        if mark not in ("", "[", "{"):
            raise ValueError(f"{file}: neither a JSON array nor JSON Lines")
        if mark:
            forms[mark == "{"].append(file)
    return forms


def read_orders(spark: SparkSession, path: str, json_lines: bool | None = None) -> DataFrame:
    """Scan the orders file or folder, every field as text.

    A file that is one JSON array of records is read whole; JSON Lines split.
    A folder may hold both: each file is read by its own form. ``json_lines``
    insists on one form, and a file of the other is an error.
    """
    forms = json_forms(spark, path)
    if json_lines is not None and forms[not json_lines]:
        raise ValueError(f"{forms[not json_lines][0]}: holds {'a JSON array' if json_lines else 'JSON Lines'}")
    reader = (spark.read
              .schema(schemas.ORDERS_FILE)
              .option("mode", "PERMISSIVE")
              .option("columnNameOfCorruptRecord", schemas.CORRUPT))
    # All files of one form are read by the path itself, so that a large folder is not named file by file.
    alone = not (forms[True] and forms[False])
    parts = [reader.option("multiLine", not lines).json(path if alone else files) for lines, files in forms.items() if files]
    return reduce(DataFrame.unionByName, parts) if parts else reader.json(path)


def encode_discount(df: DataFrame, col: str = "discount_used") -> DataFrame:
    """I4: ``Yes`` -> 1, ``No`` -> 0, anything else -> NULL (int column)."""
    return df.withColumn(col, F.expr(discount_code_sql(f"`{col}`")))


def parse_order_date(c: str = "order_date") -> Column:
    """Order date text (column ``c``) -> TIMESTAMP_NTZ, see ``order_date_sql``."""
    return F.expr(order_date_sql(f"`{c}`"))


def to_orders_schema(df: DataFrame) -> DataFrame:
    """Orders file frame -> ORDERS schema (date parsed, discount encoded).

    A value that is NaN or infinite is NULL, as the original's store has it.
    """
    types = dict(df.dtypes)
    value = "order_value" if types["order_value"] == "double" else "try_cast(trim(CAST(order_value AS STRING)) AS DOUBLE)"
    number = "order_id" if types["order_id"] == "bigint" else "try_cast(trim(CAST(order_id AS STRING)) AS BIGINT)"
    return df.selectExpr(
        f"{number} AS order_id",
        "CAST(restaurant_name AS STRING) AS restaurant_name",
        f"{order_date_sql('order_date')} AS order_date",
        f"{finite_sql(value)} AS order_value",
        f"{discount_code_sql('discount_used')} AS discount_used",
        "CAST(payment_method AS STRING) AS payment_method",
    )


#: A record that cannot be stored as it is: unreadable JSON, an id that is no
#: whole number, or a value that is no number.
REJECTED = (f"({schemas.CORRUPT} IS NOT NULL"
            " OR (order_id IS NOT NULL AND try_cast(trim(order_id) AS BIGINT) IS NULL)"
            " OR (order_value IS NOT NULL AND try_cast(trim(order_value) AS DOUBLE) IS NULL))")


def load_orders_json(spark: SparkSession, path: str, json_lines: bool | None = None,
                     reject: bool = False) -> DataFrame:
    """I3 + I4: the orders file as an ORDERS-shaped frame.

    The job fails at a record it cannot store; with ``reject`` such records are left out.
    """
    shown = f"coalesce({schemas.CORRUPT}, order_id, order_value)"
    return to_orders_schema(_stored(read_orders(spark, path, json_lines), REJECTED, shown, "orders file", reject))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Replace-write a table as Parquet (the job's commit makes it atomic per task)."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def load_report(tables: dict[str, DataFrame], rejected: dict[str, int] | None = None) -> DataFrame:
    """One row per table: ``table_name``, ``row_count`` and, if given, ``rejected_count``."""
    more = {name: [f"CAST({int(rejected.get(name, 0))} AS BIGINT) AS rejected_count"] if rejected is not None else []
            for name in tables}
    parts = [df.selectExpr(f"{sql_string(name)} AS table_name", "count(1) AS row_count", *more[name])
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def load_table(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """Scan a stored table; with its known schema no footer scan is needed."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def _file_system(spark: SparkSession, path: str):
    """(Hadoop file system, path) of ``path``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder under ``root`` that the last finished load wrote, None if there was none."""
    system, where = _file_system(spark, f"{root}/{CURRENT}")
    if not system.exists(where):
        return None
    stream = system.open(where)
    try:
        return bytes(iter(stream.read, -1)).decode()
    finally:
        stream.close()


def switch_version(spark: SparkSession, root: str, version: str) -> None:
    """Make ``version`` the current one, by replacing one small file."""
    jvm = spark.sparkContext._jvm
    system, written = _file_system(spark, f"{root}/{CURRENT}-{version.rsplit('/', 1)[-1]}")
    stream = system.create(written, True)
    stream.write(bytearray(version, "utf-8"))
    stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(system.makeQualified(written), system.makeQualified(_file_system(spark, f"{root}/{CURRENT}")[1]), options)


def _stored_path(spark: SparkSession, path: str) -> str:
    """Where the table ``path`` of a load lies: in the current version beside it, or at the path itself."""
    root, _, name = path.rstrip("/").rpartition("/")
    version = current_version(spark, root) if root else None
    return f"{root}/{version}/{name}" if version else path


def load_listings(spark: SparkSession, path: str) -> DataFrame:
    """I7 for the stored listings table."""
    return load_table(spark, _stored_path(spark, path), schemas.LISTINGS)


def load_orders(spark: SparkSession, path: str) -> DataFrame:
    """I7 for the stored orders table."""
    return load_table(spark, _stored_path(spark, path), schemas.ORDERS)


def _count_rejected(rows: DataFrame, rejected: str) -> int:
    other = next(c for c in rows.columns if c != schemas.CORRUPT)
    return rows.selectExpr(f"count_if({rejected}) AS n", f"count(`{other}`) AS more").first()["n"]


def run_load(spark: SparkSession, listings_csv: str, orders_json: str, out_dir: str,
             json_lines: bool | None = None, raw: bool = False, multi_line: bool = True,
             max_rejected: int = 0) -> DataFrame:
    """The load job: both files -> Parquet tables ``restaurants`` and ``orders``.

    ``raw`` cleans a raw listings file first (C1-C6). ``multi_line=False``
    splits a CSV without quoted newlines over tasks; otherwise a file is read
    by one task and its rows are spread before they are written. More than
    ``max_rejected`` rows of both files that cannot be stored fail the job.

    Both tables go to a new folder under ``out_dir``/``VERSIONS``, which becomes
    the current one when both are there; until then, and if the job fails,
    ``load_listings`` and ``load_orders`` of ``out_dir``/restaurants and
    ``out_dir``/orders read the pair before. Returns the load report, computed
    from the written tables.
    """
    from tavola.operators.cleaning import clean_listings

    root = out_dir.rstrip("/")
    scanned = normalise_columns(scan_listings(spark, listings_csv, multi_line))
    bad = {"restaurants": _count_rejected(scanned, rejected_listing_sql(scanned.columns, raw)),
           "orders": _count_rejected(read_orders(spark, orders_json, json_lines), REJECTED)}
    if sum(bad.values()) > max_rejected:
        raise ValueError(f"{listings_csv}: {bad['restaurants']} and {orders_json}: {bad['orders']} rows cannot be stored ({max_rejected} allowed;"
                         " a raw listings file is loaded with raw=True)")
    found = (clean_listings(read_listings(spark, listings_csv, multi_line, reject=True)) if raw
             else load_listings_csv(spark, listings_csv, multi_line, reject=True))
    if multi_line:
        found = found.repartition(spark.sparkContext.defaultParallelism)
    version = f"{VERSIONS}/{uuid4().hex}"
    write_table(found, f"{root}/{version}/restaurants")
    write_table(load_orders_json(spark, orders_json, json_lines, reject=True), f"{root}/{version}/orders")
    switch_version(spark, root, version)
    return load_report({"restaurants": load_listings(spark, f"{root}/restaurants"),
                        "orders": load_orders(spark, f"{root}/orders")}, bad)
