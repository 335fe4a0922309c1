"""Observations of search performance: (date, query, page, locale, device, country, clicks, impressions, position).

``position`` is the 1-based average. Sources that sum positions give a 0-based
sum, which becomes sum / impressions + 1. An anonymised query is the empty
string, which is not the same as null and never dropped on reading.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"date": T.DateType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "long": T.LongType(), "double": T.DoubleType()}


def _struct(**fields: str) -> T.StructType:
    return T.StructType([T.StructField(k, _KINDS[v]) for k, v in fields.items()])


SCHEMA = _struct(date="date", hour="int", query="string", is_anonymized="boolean", page="string", locale="string", device="string", country="string", clicks="long", impressions="long", position="double")
RAW = _struct(date="string", query="string", page="string", url="string", locale="string", device="string", country="string", clicks="long", impressions="long", position="double", sum_position="double", is_anonymized="boolean")


def day(value: Column) -> Column:
    """Date from the first ten characters; anything else is an error."""
    found = F.try_to_date(F.substring(value.cast("string"), 1, 10), "yyyy-MM-dd")
    return F.when(found.isNull(), F.raise_error(F.concat(F.lit("not a date: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("date")).otherwise(found)


def hour(value: Column) -> Column:
    found = F.regexp_extract(value, "T(\\d{2}):", 1)
    return F.when(found != "", found.cast("int"))


def coerce(rows: DataFrame) -> DataFrame:
    """Raw rows to observations: page from page or url, null query as empty, position from either basis, no rows without impressions."""
    have = set(rows.columns)
    col = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    query = F.coalesce(col("query", "string"), F.lit(""))
    impressions = F.coalesce(col("impressions", "long"), F.lit(0).cast("long"))
    position = F.coalesce(col("position", "double"), F.try_divide(col("sum_position", "double"), impressions.cast("double")) + 1)
    out = rows.filter(impressions > 0).select(
        day(col("date", "string")).alias("date"), hour(col("date", "string")).alias("hour"), query.alias("query"), (F.coalesce(col("is_anonymized", "boolean"), F.lit(False)) | (query == "")).alias("is_anonymized"),
        F.coalesce(col("page", "string"), col("url", "string")).alias("page"), col("locale", "string").alias("locale"), col("device", "string").alias("device"), col("country", "string").alias("country"),
        F.coalesce(col("clicks", "long"), F.lit(0).cast("long")).alias("clicks"), impressions.alias("impressions"), position.alias("position"),
    )
    return out


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType = RAW) -> DataFrame:
    """JSON lines under an explicit schema; a malformed line stops the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_rows(spark: SparkSession, folder: str) -> DataFrame:
    """All rows of a folder: ``*.jsonl`` line by line, ``*.json`` as a list or wrapped under rows, data or records. Names with a leading underscore are skipped by Spark."""
    item = RAW
    wrapped = T.StructType([*item.fields, *[T.StructField(k, T.ArrayType(item)) for k in ("rows", "data", "records")]])
    flat = item.fieldNames()
    whole = spark.read.schema(wrapped).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    inside = F.coalesce("rows", "data", "records")
    listed = whole.filter(inside.isNotNull()).select(F.explode(inside).alias("r")).select("r.*")
    bare = whole.filter(inside.isNull()).select(*flat)
    lines = spark.read.schema(item).option("mode", "FAILFAST").option("pathGlobFilter", "*.jsonl").json(folder)
    return coerce(listed.unionByName(bare).unionByName(lines))


def from_api(pages: DataFrame, dimensions: Sequence[str]) -> DataFrame:
    """API rows ``keys[], clicks, impressions, position``: keys become the dimensions; another number of keys is an error."""
    checked = F.when(F.size("keys") == len(dimensions), F.col("keys")).otherwise(F.raise_error(F.lit("row has another number of keys than dimensions")).cast("array<string>"))
    named = pages.withColumn("_keys", checked)
    return coerce(named.select(*[F.element_at("_keys", i + 1).alias(d) for i, d in enumerate(dimensions)], "clicks", "impressions", "position"))


def from_warehouse(rows: DataFrame, start: str, end: str, site_table: bool = False) -> DataFrame:
    """Bulk-export rows summed over a range of dates (which prunes partitions of a table laid out by date); the site table has no page."""
    sums = "sum_top_position" if site_table else "sum_position"
    keys = ["data_date", "query", *([] if site_table else ["url"]), "device", "country"]
    held = rows.filter(F.col("data_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    out = held.groupBy(*keys).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum(sums).alias("sum_position"))
    out = out.withColumn("position", F.round(F.col("sum_position") / F.col("impressions") + 1, 4)).withColumnRenamed("data_date", "date")
    return out.withColumnRenamed("url", "page") if not site_table else out.withColumn("page", F.lit(None).cast("string"))


def epochs(log: DataFrame, agenda: str = "SEARCHDATA") -> DataFrame:
    return log.filter(F.col("agenda") == agenda).groupBy("data_date").agg(F.max("epoch_version").alias("epoch_version"))


#: Headers of exports in several languages.
HEADERS: Mapping[str, str] = {
    "query": "query", "queries": "query", "top queries": "query",
    "запрос": "query", "запит": "query", "поисковый запрос": "query",
    "page": "page", "pages": "page", "top pages": "page", "landing page": "page",
    "страница": "page", "сторінка": "page",
    "date": "date", "дата": "date",
    "country": "country", "страна": "country", "країна": "country",
    "device": "device", "устройство": "device", "пристрій": "device",
    "clicks": "clicks", "клики": "clicks", "кліки": "clicks",
    "impressions": "impressions", "показы": "impressions", "покази": "impressions",
    "ctr": "ctr",
    "position": "position", "average position": "position",
    "позиция": "position", "позиція": "position",
}


def read_csv(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    """An export with any of , ; tab between the columns, localised headers, a byte order mark, decimal commas. ``date`` is for exports without one."""
    head = spark.read.text(path).limit(1).collect()
    if not head:
        return spark.createDataFrame([], SCHEMA)
    line = head[0][0].lstrip("﻿")
    sep = max(",;\t", key=line.count)
    names = [HEADERS.get(x.strip().strip('"').lower(), x.strip().strip('"').lower()) for x in line.split(sep)]
    raw = spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path, sep=sep, header=True, enforceSchema=True)
    whole = lambda c: number(c, "[\\s ,]", "")
    real = lambda c: number(c, ",", ".")
    out = raw.withColumn("clicks", F.coalesce(whole("clicks"), F.lit(0.0)).cast("long")).withColumn("impressions", F.coalesce(whole("impressions"), F.lit(0.0)).cast("long"))
    if "position" in names:
        out = out.withColumn("position", real("position"))
    if "date" not in names:
        out = out.withColumn("date", F.lit(date))
    return coerce(out.drop("ctr"))


def number(name: str, pattern: str, by: str) -> Column:
    clean = F.regexp_replace(F.btrim(F.col(name)), pattern, by)
    value = clean.try_cast("double")
    bad = F.when((clean != "") & value.isNull(), F.raise_error(F.concat(F.lit(f"{name}: not a number: "), F.col(name))).cast("double"))
    return F.coalesce(bad, value)


def locale_of(page: Column, rules: Sequence[Mapping[str, str]], longest_wins: bool = False) -> Column:
    """Locale of a URL by rules with any of ``prefix``, ``host``, ``pattern`` and ``url_pattern``, in order or the longest first."""
    own = lambda r: r.get("prefix") or r.get("url_pattern") or r.get("host") or r.get("pattern") or ""
    rules = sorted(rules, key=lambda r: -len(own(r))) if longest_wins else list(rules)
    path = F.coalesce(F.try_parse_url(page, F.lit("PATH")), page)
    host = F.coalesce(F.try_parse_url(page, F.lit("HOST")), F.lit(""))
    tests = []
    for r in rules:
        if "prefix" in r or "url_pattern" in r:
            p = r.get("prefix") or r["url_pattern"]
            test = page.startswith(p) if "://" in p else path.startswith(p)
        elif "host" in r:
            test = (host == r["host"]) | host.startswith(r["host"]) | host.endswith("." + r["host"])
        else:
            test = page.rlike(r["pattern"])
        tests.append(F.when(test, F.lit(r["locale"])))
    return F.coalesce(*tests, F.lit(None).cast("string")) if tests else F.lit(None).cast("string")


def branded(query: Column, brand: Sequence[str]) -> Column:
    """Whether a normalised query holds a brand token."""
    out = F.lit(False)
    for token in brand:
        out = out | F.contains(query, F.lit(token.lower()))
    return out
