"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Fixed value: the white-space code points of the word pattern [^\x20\x09-\x0D]+.
SPACE_CHARS = " \t\n\x0b\x0c\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table below ``sf_dir``, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local session (tests) gets a temporary folder; on a cluster that is an error, as each machine would write to its own disk.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None) or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not conf and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (conf or f"file://{tempfile.gettempdir()}/checkpoints/pulsegrid").rstrip("/")


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: what follows no longer depends on shuffle files of executors that may be
    lost, and ids drawn with monotonically_increasing_id() are fixed once written. The files are
    removed by ``discard``, at the latest when the application's file system handle closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at, system = _folder(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from ``written`` that everything which needs them has read: no result that is still to be computed may."""
    for df in tables:
        at, system = _folder(df.sparkSession, df._written_path)
        system.delete(at, True)
        system.cancelDeleteOnExit(at)


def numbered(rows: DataFrame, keys: list[str], order: list[Column], tag: str, **before: str) -> DataFrame:
    """``rows`` with their place in ``order`` (from 1) within their group of ``keys`` in _place, and sums over the rows before, named by ``before``.

    Rows are sorted into ranges over all tasks and written; places within a range are counted there, and each range adds
    the counts of the ranges before it. So a group of any size is spread over tasks; what is ordered in one task is a row for each range.
    """
    ordered = rows.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    names = [*keys, *(f"_o{i}" for i in range(len(order)))]
    ranged = written(ordered.repartitionByRange(*names).withColumn("_range", F.spark_partition_id()), tag)
    sums = {"_place": F.count("*"), **{n: F.sum(c) for n, c in before.items()}}
    parts = ranged.groupBy(*keys, "_range").agg(*(c.alias(f"_all{n}") for n, c in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*(F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_all{n}").over(earlier), F.lit(0)).alias(f"_from{n}") for n in sums))
    on = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_g{i}"))
    within = Window.partitionBy(*keys, "_range").orderBy(*names[len(keys) :])
    above = within.rowsBetween(Window.unboundedPreceding, -1)
    here = {"_place": F.row_number().over(within), **{n: F.coalesce(F.sum(c).over(above), F.lit(0)) for n, c in before.items()}}
    out = ranged.withColumns(here).join(parts, on)
    return out.withColumns({n: F.col(n) + F.col(f"_from{n}") for n in sums}).select(*rows.columns, *sums)


def without_chars(text: Column, chars: str) -> Column:
    """``text`` without any of ``chars``; a chain of literal byte replacements, which stays in codegen and beats a regex."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def blank_spaced(text: Column) -> Column:
    """``text`` with each white-space code point other than the blank turned into a blank."""
    for c in SPACE_CHARS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def ascii_lower(text: Column) -> Column:
    return F.translate(text, ASCII_UPPER, ASCII_LOWER)


def keyed(docs: DataFrame, id_col: str) -> tuple[DataFrame, str]:
    """``docs`` and the name of a column of it that tells its rows apart: ``id_col`` where no id is null or repeated.

    Else the rows are written with a number each, and the key is a new column of (id is null, id, number), which sorts as the ids do.
    """
    ids = docs.groupBy(id_col).count()
    if ids.where((F.col("count") > 1) | F.col(id_col).isNull()).isEmpty():
        return docs, id_col
    name = f"key_{uuid.uuid4().hex}"
    number = F.monotonically_increasing_id()
    return written(docs.withColumn(name, F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), number.alias("row"))), "keyed"), name


def keep_rows(docs: DataFrame, id_col: str, decide: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The rows of ``docs``, all columns as they were, that ``decide`` keeps: it gets a table and its key column and returns doc_id and kept.

    Rows are dropped by an anti-join with the dropped keys, which are the fewer; Spark broadcasts them only where they are few.
    """
    source, key = keyed(docs, id_col)
    dropped = written(decide(source, key).where(~F.col("kept")).select(F.col("doc_id").alias("dropped_key")), "dropped")
    return source.join(dropped, source[key] == dropped["dropped_key"], "left_anti").select(*(source[c] for c in docs.columns))
