"""Readers of the small and large files around the observations. Control files are read on the driver, tables stay distributed."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text through Spark's own file systems, None if it isn't there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return "\n".join(row["value"] for row in spark.read.text(path, wholetext=True).collect())


def load_config(spark: SparkSession, path: str) -> dict[str, Any]:
    """A YAML or JSON file; one that isn't there is empty."""
    text = read_text(spark, path)
    if text is None:
        return {}
    if path.endswith(".json"):
        return json.loads(text)
    import yaml

    return yaml.safe_load(text) or {}


def brand_tokens(config: Mapping[str, Any] | str) -> list[str]:
    """Brand tokens of a configuration (``brand.tokens`` or ``brand_tokens``), or one to a line with # comments."""
    if isinstance(config, str):
        found = [line.partition("#")[0].strip() for line in config.splitlines()]
    else:
        brand = config.get("brand", {})
        found = (brand.get("tokens") if isinstance(brand, Mapping) else brand) or config.get("brand_tokens") or []
    return sorted({str(x).strip().lower() for x in found if str(x).strip()})


def read_corpus(spark: SparkSession, text: str) -> DataFrame:
    """Pages (url, cluster, expected_intent, published_at) from JSON: a map by url, a list, or either under ``pages``."""
    loaded = json.loads(text)
    if isinstance(loaded, Mapping) and "pages" in loaded:
        loaded = loaded["pages"]
    rows = [{"url": url, **page} for url, page in loaded.items()] if isinstance(loaded, Mapping) else loaded
    names = ("url", "cluster", "expected_intent", "published_at")
    return spark.createDataFrame([tuple(None if r.get(n) is None else str(r[n]) for n in names) for r in rows], ", ".join(f"{n} string" for n in names))


def read_profiles(spark: SparkSession, text: str) -> DataFrame:
    """Result pages (query, profile) from JSON: query to profile, query to an object with ``profile`` or ``aio``, or a list of such objects."""
    loaded = json.loads(text)
    items = [(x.get("query"), x) for x in loaded] if isinstance(loaded, list) else loaded.items()
    name = lambda x: x if isinstance(x, str) else x.get("profile") or ("aio" if x.get("aio") else "clean")
    return spark.createDataFrame([(q, name(x)) for q, x in items], "query string, profile string")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Vectors (id, vector): Parquet or JSON lines as a table, a JSON map or an ``.npz`` archive on the driver."""
    if path.endswith(".npz"):
        import io

        import numpy as np

        data = spark.read.format("binaryFile").load(path).first()["content"]
        with np.load(io.BytesIO(bytes(data))) as held:
            return spark.createDataFrame([(k, [float(x) for x in held[k]]) for k in held.files], "id string, vector array<double>")
    if path.endswith(".json"):
        return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in json.loads(read_text(spark, path) or "{}").items()], "id string, vector array<double>")
    rows = spark.read.schema("id string, vector array<double>").json(path) if path.endswith(".jsonl") else spark.read.parquet(path)
    return rows.select(F.col("id").cast("string").alias("id"), F.col("vector").cast("array<double>").alias("vector"))


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Whole text files of a folder (name, text), tags stripped from HTML."""
    rows = spark.read.text(folder, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("name"), F.col("value").alias("text"))
    return rows.filter(F.col("name").rlike("\\.(txt|md|html?)$")).withColumn("text", F.when(F.col("name").rlike("\\.html?$"), F.regexp_replace("text", "<[^>]+>", " ")).otherwise(F.col("text")))


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of all Markdown files under a folder: file, line_no, text."""
    rows = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    split = rows.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]+)$", 1).alias("file"), F.posexplode(F.split("value", "\\r?\\n")).alias("_i", "text"))
    return split.select("file", (F.col("_i") + 1).alias("line_no"), "text")


def read_manifest_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every file under a folder with the hash of its bytes: path, found."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", F.sha2("content", 256).alias("found"))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Entries of sitemaps: url, lastmod."""
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).select(F.btrim("loc").alias("url"), F.btrim("lastmod").alias("lastmod"))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Stored answers of engines; failures keep their ``error`` and are never dropped."""
    return spark.read.schema("engine string, grounding string, prompt_id string, repeat int, answer string, cited array<string>, error string").json(path)


def read_pages_of_adapter(spark: SparkSession, path: str) -> DataFrame:
    """Documents of paged responses, one JSON object to a line: {ok, result: {items: [...]}}; a page that isn't ok is an error."""
    pages = spark.read.schema("ok boolean, error string, result struct<items: array<struct<id: string, url: string, updated_at: string, text: string>>>").json(path)
    checked = F.when(F.col("ok"), F.col("result.items")).otherwise(F.raise_error(F.concat(F.lit("page of documents failed: "), F.coalesce("error", F.lit("no reason")))).cast("array<struct<id: string, url: string, updated_at: string, text: string>>"))
    return pages.select(F.explode(checked).alias("_i")).select("_i.*")


def between(spark: SparkSession, sql: str, start: str, end: str, **frames: DataFrame) -> DataFrame:
    """A query with the parameters :start and :end over named frames."""
    return spark.sql(sql, args={"start": start, "end": end}, **frames) if not frames else spark.sql(sql.format(**{k: f"{{{k}}}" for k in frames}), args={"start": start, "end": end}, **frames)


def text_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
