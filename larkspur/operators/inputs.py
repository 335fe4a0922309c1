"""Inputs of the query graph and of the detectors, checked: what is wrong is refused with its names, never guessed at."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.sources.observations import locale_of

#: Names that an error message lists.
SHOWN = 10


class InputError(ValueError):
    """An input that can't be used."""


def refuse(rows: DataFrame, message: str) -> None:
    """An error that names the first rows, if there are any."""
    found = [", ".join(str(x) for x in row) for row in rows.limit(SHOWN).collect()]
    if found:
        raise InputError(f"{message}: {'; '.join(found)}")


def intent_name(value: Column) -> Column:
    """An intent label without ``-seeking``; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.btrim(value)), "-seeking$", ""), F.lit(""))


def graph_queries(queries: DataFrame, priorities: DataFrame | None = None, intents: DataFrame | None = None, pillars: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Queries with priority, intents and pillar from their own tables, else from their rows.

    ``queries``: ``id``, ``text_norm``, ``lang``, ``geo`` and any of ``device``, ``is_verified``, ``priority``, ``intent_commercial``,
    ``intent_cognitive``. An id may occur once; without a device it is desktop, without a mark not verified. The other tables have ``query_id``.
    """
    have = set(queries.columns)
    own = lambda name, kind: F.col(name).cast(kind) if name in have else F.lit(None).cast(kind)
    if check:
        refuse(queries.groupBy("id").count().filter("count > 1").select("id"), "duplicate query id")
        refuse(queries.filter(F.greatest(*[F.col(c).isNull().cast("int") for c in ("id", "text_norm", "lang", "geo")]) == 1).select("id"), "query lacks a field")
    out = queries.select("id", "text_norm", "lang", "geo", F.coalesce(own("device", "string"), F.lit("desktop")).alias("device"), F.coalesce(own("is_verified", "boolean"), F.lit(False)).alias("is_verified"), own("priority", "double").alias("_p"), intent_name(own("intent_commercial", "string")).alias("_c"), intent_name(own("intent_cognitive", "string")).alias("_g"))
    parts = [(priorities, {"_p2": lambda c: F.col("priority").cast("double")}), (intents, {"_c2": lambda c: intent_name(F.col("intent_commercial")), "_g2": lambda c: intent_name(F.col("intent_cognitive"))}), (pillars, {"pillar_id": lambda c: F.col("pillar_id"), "pillar_source": lambda c: F.col("pillar_source")})]
    if pillars is not None and check:
        refuse(pillars.filter(~F.col("pillar_source").isin("declared", "inferred")).select("query_id", "pillar_source"), "pillar_source is neither declared nor inferred")
    for frame, made in parts:
        if frame is None:
            out = out.withColumns({name: F.lit(None).cast("double" if name == "_p2" else "string") for name in made})
        else:
            out = out.join(frame.select(F.col("query_id").alias("id"), *[f(None).alias(name) for name, f in made.items()]).dropDuplicates(["id"]), "id", "left")
    return out.select("id", "text_norm", "lang", "geo", "device", "is_verified", F.coalesce("_p2", "_p").alias("priority"), F.coalesce("_c2", "_c").alias("intent_commercial"), F.coalesce("_g2", "_g").alias("intent_cognitive"), "pillar_id", "pillar_source")


def scope_key() -> Column:
    return F.concat_ws("-", "lang", "geo", "device")


def scoped(queries: DataFrame, locale: str | None = None) -> DataFrame:
    """The queries of one locale (lang-geo-device). Without ``locale`` a mixed input is refused, one that matches nothing too."""
    if locale is None:
        seen = [row[0] for row in queries.select(scope_key()).distinct().limit(SHOWN + 1).collect()]
        if len(seen) > 1:
            raise InputError(f"locales are mixed: {', '.join(sorted(seen))}; clusters never span locales")
        return queries
    out = queries.filter(scope_key() == locale)
    if out.isEmpty():
        raise InputError(f"no query of locale {locale}")
    return out


def scopes(queries: DataFrame) -> DataFrame:
    """Queries, and verified ones, of each locale: what a run on one of them leaves out."""
    return queries.groupBy(scope_key().alias("scope")).agg(F.count(F.lit(1)).alias("queries"), F.sum(F.col("is_verified").cast("int")).cast("long").alias("verified"))


def with_locale(obs: DataFrame, rules: Sequence[Mapping[str, str]], declared: Sequence[str] = (), locale: str | None = None, check: bool = True) -> DataFrame:
    """Observations with their locale: their own, by the rules, or the only declared one. Rows that get none are refused; ``locale`` keeps one."""
    only = F.lit(declared[0]) if len(declared) == 1 else F.lit(None).cast("string")
    out = obs.withColumn("locale", F.coalesce("locale", locale_of(F.col("page"), rules), only))
    if check:
        refuse(out.filter("locale is null").select("page").distinct(), "no locale for")
    return out if locale is None else out.filter(F.col("locale") == locale)


def unresolved_locales(obs: DataFrame, rules: Sequence[Mapping[str, str]], declared: Sequence[str] = ()) -> DataFrame:
    """Pages without a locale and their impressions."""
    held = with_locale(obs, rules, declared, check=False)
    return held.filter("locale is null").groupBy("page").agg(F.sum("impressions").alias("impressions"))


def section_offsets(sections: DataFrame) -> DataFrame:
    """The number of words before each section. ``draft``, ``pos``, ``words``."""
    from pyspark.sql import Window

    w = Window.partitionBy("draft").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return sections.withColumn("offset", F.coalesce(F.sum("words").over(w), F.lit(0)).cast("long"))


def flag_columns(table: DataFrame, prefix: str = "is_") -> list[str]:
    """Columns of a warehouse table whose name begins with ``prefix``, in order."""
    return sorted(c for c in table.columns if c.startswith(prefix))
