"""File readers and writers."""

from __future__ import annotations

import csv
import io
import uuid
from datetime import date

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerpulse.functions.coerce import null_tokens

FORMATS = ("csv", "parquet", "json", "orc")


#: Where ``load_file`` puts the text of a row that does not fit the header.
BAD_ROW = "_bad_row"


def load_file(
    spark: SparkSession,
    path: str,
    file_type: str = "auto",
    multiline: bool = False,
    bad_rows: str = "fail",
    schema: StructType | str | None = None,
) -> DataFrame:
    """Read one table, choosing the format from the suffix of ``path``.

    A CSV column stays text here and gets its type in ``cleaning.clean``, so no
    inference pass over the data is needed and ids keep their leading zeros.
    ``multiline`` allows line breaks inside quotes, at the price of files that
    one task must read as a whole. A CSV row with more or fewer cells than the
    header fails the read; ``bad_rows="keep"`` leaves its text in the column
    BAD_ROW and its cells empty. ``schema`` spares JSON its inference pass.
    """
    if file_type == "auto":
        file_type = path.rstrip("/").rsplit("/", 1)[-1].rpartition(".")[2].lower()
    if file_type not in FORMATS:
        raise ValueError(f"unsupported file type: {file_type!r} (expected one of {', '.join(FORMATS)})")
    if file_type != "csv":
        reader = spark.read.format(file_type)
        return (reader.schema(schema) if schema else reader).load(path)
    # enforceSchema off: a file whose header names other columns fails instead of filling the wrong ones
    options = {"header": True, "escape": '"', "multiLine": multiline, "enforceSchema": False, "columnPruning": False}
    names = spark.read.options(**options).csv(path).columns
    if bad_rows == "fail":
        raw = spark.read.options(**options, mode="FAILFAST").csv(path)
        return raw.select(*[null_tokens(F.col(f"`{c}`")).alias(c) for c in names])
    text = StructType([StructField(c, StringType()) for c in [*names, BAD_ROW]])
    raw = spark.read.schema(text).options(**options, columnNameOfCorruptRecord=BAD_ROW).csv(path)
    good = F.col(BAD_ROW).isNull()
    return raw.select(*[F.when(good, null_tokens(F.col(f"`{c}`"))).alias(c) for c in names], BAD_ROW)


def split_bad_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that fit the header, and the text of those that do not, of a file read with ``bad_rows="keep"``."""
    return raw.where(~is_bad_row(raw)).drop(BAD_ROW), raw.where(is_bad_row(raw)).select(BAD_ROW)


def is_bad_row(raw: DataFrame) -> Column:
    """Spark reads the text of a bad row only together with a cell, which is empty there."""
    return F.col(BAD_ROW).isNotNull() & F.col(f"`{raw.columns[0]}`").isNull()


def export_csv(df: DataFrame, path: str) -> str:
    """Write a result with a header row; one file per partition."""
    df.write.mode("overwrite").csv(path, header=True, escape='"')
    return path


def export_dated_csv(df: DataFrame, directory: str, name: str, day: date | None = None) -> str:
    """Write a result as one CSV file ``<directory>/<name>_<yyyymmdd>.csv`` with a header, in the order of ``df``; returns its path.

    All tasks write their parts side by side. The file system then puts them behind the header: it links them where it
    can, elsewhere their bytes are copied from file to file, never as rows and never by one task. The file appears, or
    replaces the one of that day, in one step when it is whole.
    """
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    make = jvm.org.apache.hadoop.fs.Path
    target = f"{directory.rstrip('/')}/{dated_name(name, day)}"
    work = f"{directory.rstrip('/')}/_{dated_name(name, day)}-{uuid.uuid4().hex}"
    fs = make(work).getFileSystem(conf)
    try:
        df.write.csv(f"{work}/parts", escape='"')
        found = [s.getPath() for s in fs.listStatus(make(f"{work}/parts")) if s.getPath().getName().startswith("part-")]
        parts = sorted(found, key=lambda p: int(p.getName().split("-")[1]))
        header = io.StringIO()
        csv.writer(header, lineterminator="\n").writerow(df.columns)
        whole = make(f"{work}/whole")
        out = fs.create(whole, True)
        out.write(bytearray(header.getvalue().encode()))
        out.close()
        _append(spark, fs, whole, parts)
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
        how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(fs.makeQualified(whole), fs.makeQualified(make(target)), how)
    finally:
        fs.delete(make(work), True)
    return target


def _append(spark: SparkSession, fs, whole, parts: list) -> None:
    """Put the parts behind ``whole``, without moving data where the file system knows how."""
    if not parts:
        return
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    sources = gateway.new_array(jvm.org.apache.hadoop.fs.Path, len(parts))
    for i, part in enumerate(parts):
        sources[i] = part
    try:
        fs.concat(whole, sources)
        return
    except UnsupportedOperationException:
        pass
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    header = fs.open(whole)
    joined = jvm.org.apache.hadoop.fs.Path(f"{whole.toString()}-joined")
    out = fs.create(joined, True)
    for source in [header, *(fs.open(p) for p in parts)]:
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, conf, False)
        source.close()
    out.close()
    fs.delete(whole, False)
    fs.rename(joined, whole)


def dated_name(name: str, day: date | None = None) -> str:
    """File name of an export: ``<name>_<yyyymmdd>.csv``."""
    return f"{name}_{day or date.today():%Y%m%d}.csv"


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    """Write a cleaned or merged table as parquet."""
    df.write.mode("overwrite").parquet(path, partitionBy=list(partition_by) or None)
    return path
