"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of every contract of this subpackage, as a regular expression class and as characters.
SPACE = "[\\x20\\x09-\\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset and all runs in one process."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy", **options: object) -> DataFrame:
    """The same rows, written as Parquet to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", compression).options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the files of tables made by :func:`written` that no later plan reads."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once for a row, however often ``use`` refers to it, lambdas included."""
    return F.element_at(F.transform(F.array(value), use), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z as a-z and nothing else changed. Texts of ASCII only take the quick way."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def split_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` in order; null or blank: none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(F.length(trimmed) == 0, F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def least_by_hash(rows: DataFrame, most: int, *key: str) -> DataFrame:
    """At most ``most`` rows, the least by a hash of ``key``.

    The rows are counted first and a range of hashes is taken that has twice as
    many as are wanted, so what each task passes on doesn't add up to more than that.
    """
    n, places = rows.count(), 1 << 30
    hashed = F.xxhash64(*key)
    if n > 2 * most:
        rows = rows.filter(F.pmod(hashed, F.lit(places)) < max(1, 2 * most * places // n))
    return rows.orderBy(F.pmod(hashed, F.lit(places)), *key).limit(most)


def own_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores more as make it differ from all columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
