"""Reading and writing fact tables and request tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from countcast.operators.numbering import numbered, numbered_as_stored, numbered_in_files
from countcast.spec import CountSpec

FORMATS = ("parquet", "csv", "json", "orc")


def read_facts(
    spark: SparkSession,
    path: str,
    spec: CountSpec,
    format: str = "parquet",
    headers: Mapping[str, str] | None = None,
    infer: bool = False,
) -> DataFrame:
    """Read a fact table with the spec's schema.

    ``headers`` maps column names in the file to the spec's names. Schema inference
    reads a text file twice, so it is off unless asked for; the columns are then cast
    to the spec's types.
    """
    if format not in FORMATS:
        raise ValueError(f"format {format!r} is not one of {FORMATS}")
    reader = spark.read.format(format)
    if format == "csv":
        # enforceSchema off: a file whose header disagrees with the schema is an error.
        reader = reader.option("header", True).option("inferSchema", infer).option("enforceSchema", infer)
    if not infer:
        reader = reader.schema(_file_schema(spec, headers, format))
    df = reader.load(path)
    names = {name: header for header, name in (headers or {}).items()}
    return df.select(
        *(F.col(f"`{names.get(f.name, f.name)}`").cast(f.dataType).alias(f.name) for f in spec.fact_schema())
    )


CORRUPT = "_corrupt_record"
WHOLE_NUMBER = "^[+-]?[0-9]+$"


def read_checked_facts(
    spark: SparkSession, path: str, spec: CountSpec, format: str = "csv", headers: Mapping[str, str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(good, faulty)``: facts of text files as ``read_facts`` gives them, and the rows it cannot read.

    Every line is in one of them. Faulty rows are ``(file, reason, line)``: lines that are not
    CSV or JSON of the expected fields, and counts that are no whole number of 64 bits. A
    missing value is no fault. All fields are read as text, so that a row's fault does
    not depend on which columns a query asks for.
    """
    if format not in ("csv", "json"):
        raise ValueError(f"format {format!r} keeps types itself: use read_facts")
    shape = T.StructType([T.StructField(f.name, T.StringType()) for f in _file_schema(spec, headers, format).fields])
    schema = T.StructType([*shape.fields, T.StructField(CORRUPT, T.StringType())])
    reader = spark.read.format(format).schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if format == "csv":
        reader = reader.option("header", True).option("columnPruning", False).option("enforceSchema", False)
    names = {name: header for header, name in (headers or {}).items()}
    count = F.col(f"`{names.get(spec.target, spec.target)}`")
    unread = count.isNotNull() & (~count.rlike(WHOLE_NUMBER) | count.try_cast("bigint").isNull())
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed line").when(unread, f"{spec.target} is no whole number")
    checked = reader.load(path).withColumn("reason", reason)
    facts = (F.col(f"`{names.get(f.name, f.name)}`").try_cast(f.dataType).alias(f.name) for f in spec.fact_schema())
    whole_row = F.to_json(F.struct(*(F.col(f"`{f.name}`") for f in shape.fields)))
    line = F.coalesce(F.col(CORRUPT), whole_row).alias("line")
    faulty = checked.where("reason is not null").select(F.col("_metadata.file_path").alias("file"), "reason", line)
    return checked.where("reason is null").select(*facts), faulty


def quarantine_facts(
    spark: SparkSession, path: str, spec: CountSpec, faulty_path: str, format: str = "csv", headers: Mapping[str, str] | None = None
) -> DataFrame:
    """The good facts; faulty rows are appended to a Parquet table, with their files and reasons."""
    good, faulty = read_checked_facts(spark, path, spec, format, headers)
    faulty.write.mode("append").parquet(faulty_path)
    return good


def _file_schema(spec: CountSpec, headers: Mapping[str, str] | None, format: str) -> T.StructType:
    names = {name: header for header, name in (headers or {}).items()}
    known = {names.get(f.name, f.name): f.dataType for f in spec.fact_schema()}
    if format != "csv" or not headers:
        return T.StructType([T.StructField(name, dtype) for name, dtype in known.items()])
    # A CSV schema is matched by position: keep the order of the file's header, all of it.
    return T.StructType([T.StructField(name, known.get(name, T.StringType())) for name in headers])


def write_facts(
    df: DataFrame,
    path: str,
    format: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "errorifexists",
) -> None:
    """Write a fact table; ``partition_by`` lets later reads skip whole folders."""
    writer = df.write.format(format).mode(mode)
    if format == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def requests_from_rows(
    spark: SparkSession, rows: Iterable[Mapping[str, str]], spec: CountSpec
) -> DataFrame:
    """A few request objects as a table; ``request_id`` is their position.

    The schema is explicit and not nullable: a missing dimension is refused here, as a
    request validator would. Large request sets belong in files (``read_requests``).
    """
    data = [(i, *(row.get(d) for d in spec.dims)) for i, row in enumerate(rows)]
    return spark.createDataFrame(data, spec.request_schema())


def read_requests(spark: SparkSession, path: str, spec: CountSpec, format: str = "json") -> DataFrame:
    """A request table from files. Files may hold nulls; scoring rejects such rows."""
    reader = spark.read.format(format).schema(spec.request_schema())
    if format == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def read_unnumbered_requests(spark: SparkSession, path: str, spec: CountSpec, format: str = "json") -> DataFrame:
    """A request table from files without numbers: ``request_id`` is the place in the files,
    by file name and then by line or row, 0 to n - 1."""
    columns = [f for f in spec.request_schema().fields if f.name != "request_id"]
    reader = spark.read.format(format).schema(T.StructType([T.StructField(f.name, f.dataType) for f in columns]))
    if format == "csv":
        reader = reader.option("header", True)
    scan = reader.load(path)
    numbered_rows = numbered_as_stored(scan, "request_id") if format == "parquet" else numbered_in_files(scan, "request_id")
    return numbered_rows.select("request_id", *spec.dims)


def request_table(facts: DataFrame, spec: CountSpec, distinct: bool = True) -> DataFrame:
    """One request per dimension combination, numbered 0 to n - 1 in the order of the dimensions.

    Numbers come from a distributed sort and counts by partition: none is missing, none
    occurs twice, whatever the size. A table whose combinations are known to be unique, such as
    a fact table, needs no ``distinct``.
    """
    combinations = facts.select(*spec.dims)
    if distinct:
        combinations = combinations.distinct()
    return numbered(combinations, spec.dims, "request_id").select("request_id", *spec.dims)
