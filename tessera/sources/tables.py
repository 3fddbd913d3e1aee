"""Reading tables through Spark only, so that any store Spark knows will do."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.schemas import TABLES


#: path -> files of the path and schema found then
_SCHEMAS: dict[str, tuple[tuple, T.StructType]] = {}


def _found(spark: SparkSession, path: str) -> tuple | None:
    """Name, time of change and length of a path's files, or None without any."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    matches = system.globStatus(where)
    if not matches:
        return None
    files = [f for m in matches for f in (system.listStatus(m.getPath()) if m.isDirectory() else [m])]
    return tuple(sorted((f.getPath().toString(), f.getModificationTime(), -1 if f.isDirectory() else f.getLen()) for f in files))


def has_table(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return _found(spark, f"{sf_dir}/{name}.parquet") is not None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a dataset folder. Its schema is read again only when a file of it has changed.

    Where the store keeps no times, and of tables with folders in them, it is read each time.
    """
    path = f"{sf_dir}/{name}.parquet"
    files = _found(spark, path)
    known = files and all(time > 0 and size >= 0 for _, time, size in files)
    if known and path in _SCHEMAS and _SCHEMAS[path][0] == files:
        return spark.read.schema(_SCHEMAS[path][1]).parquet(path)
    rows = spark.read.parquet(path)
    if known:
        _SCHEMAS[path] = (files, rows.schema)
    return rows


def read_delimited(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A ``|``-delimited file without header, each row ended by ``|``.

    A missing file, a malformed number and a row with missing fields raise when the rows are read.
    A null in a column that the DDL declares NOT NULL raises too.
    """
    schema = TABLES[name]
    fields = [*schema.fields, T.StructField("_end", T.StringType(), True)]
    raw = (
        spark.read.schema(T.StructType([T.StructField(f.name, f.dataType, True) for f in fields]))
        .option("sep", "|")
        .option("header", "false")
        .option("mode", "FAILFAST")
        .option("dateFormat", "yyyy-MM-dd")
        .option("quote", "")
        .option("columnPruning", "false")  # else a short row passes when its missing fields aren't selected
        .csv(path)
    )
    checked = [
        F.col(f.name)
        if f.nullable or isinstance(f.dataType, T.StringType)
        else F.coalesce(F.col(f.name), F.raise_error(F.lit(f"{name}.{f.name} is null")).cast(f.dataType)).alias(f.name)
        for f in schema.fields
    ]
    return raw.select(*checked)


def read_delimited_dir(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(TABLES)) -> dict[str, DataFrame]:
    """All named ``.tbl`` files of a folder."""
    return {name: read_delimited(spark, f"{folder}/{name}.tbl", name) for name in names}


def convert_to_parquet(spark: SparkSession, folder: str, out: str, names: tuple[str, ...] = tuple(TABLES)) -> None:
    """Bulk load: delimited files into the Parquet layout the queries read."""
    for name, frame in read_delimited_dir(spark, folder, names).items():
        frame.write.mode("overwrite").parquet(f"{out}/{name}.parquet")


def load_checked(spark: SparkSession, folder: str, out: str, expected: dict[str, int], names: tuple[str, ...] = tuple(TABLES)) -> dict[str, int]:
    """Row counts after a bulk load: tables that are missing from ``out`` or not of the expected size are loaded again, the others left.

    Raises if a table still isn't of its expected size then.
    """
    for name in names:
        rows = table(spark, out, name).count() if has_table(spark, out, name) else -1
        if rows < 0 or rows != expected.get(name, rows):
            convert_to_parquet(spark, folder, out, (name,))
    return validate_dataset(spark, out, names, expected)


def verify_delimited(spark: SparkSession, folder: str, names: tuple[str, ...] = tuple(TABLES)) -> dict[str, tuple[int, int]]:
    """Bytes and lines of all named ``.tbl`` files; raises if one is missing or empty. Nothing is parsed."""
    out, missing = {}, []
    for name in names:
        files = _found(spark, f"{folder}/{name}.tbl")
        size = sum(max(0, f[2]) for f in files or ())
        if not size:
            missing.append(name)
        else:
            out[name] = (size, spark.read.text(f"{folder}/{name}.tbl").count())
    if missing:
        raise ValueError(f"missing or empty: {', '.join(missing)}")
    return out


def validate_dataset(spark: SparkSession, sf_dir: str, names: tuple[str, ...], expected: dict[str, int] | None = None) -> dict[str, int]:
    """Row counts of all named tables; raises if one is missing, empty or not of the expected size."""
    counts = {name: table(spark, sf_dir, name).count() for name in names}
    wrong = {n: c for n, c in counts.items() if c == 0 or (expected and n in expected and expected[n] != c)}
    if wrong:
        raise ValueError(f"unexpected row counts: {wrong}")
    return counts
