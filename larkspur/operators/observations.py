"""Aggregates and detectors over observations. Every function takes and returns DataFrames; thresholds are read on the driver and go into the plan as literals."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.graph import ordinal
from larkspur.functions.scores import cosine, expected_ctr, ratio
from larkspur.sources.observations import branded
from larkspur.thresholds import Thresholds

Span = tuple[dt.date, dt.date]


def windows(as_of: dt.date, trim: int = 4, days: int = 28) -> tuple[Span, Span]:
    """The current and the prior window, of equal length, before the provisional tail."""
    end = as_of - dt.timedelta(days=trim)
    cut = end - dt.timedelta(days=days)
    return (cut + dt.timedelta(days=1), end), (cut - dt.timedelta(days=days - 1), cut)


def effective_window(start: dt.date, end: dt.date, today: dt.date, trim: int = 4) -> Span:
    """A requested range without the provisional days; an error if nothing is left."""
    last = min(end, today - dt.timedelta(days=trim))
    if last < start:
        raise ValueError("the whole range is provisional")
    return start, last


def within(obs: DataFrame, span: Span, col: str = "date") -> DataFrame:
    return obs.filter(F.col(col).between(F.lit(span[0]), F.lit(span[1])))


def aggregate(obs: DataFrame, *keys: str) -> DataFrame:
    """Clicks, impressions, ctr and the position weighted by the impressions of rows that have one."""
    weight = F.sum(F.when(F.col("position").isNotNull(), F.col("impressions")))
    out = obs.groupBy(*keys).agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.try_divide(F.sum(F.col("position") * F.col("impressions")), weight.cast("double")).alias("position"))
    return out.withColumn("ctr", ratio(F.col("clicks"), F.col("impressions")))


def collapse(obs: DataFrame) -> DataFrame:
    """Duplicates by (query, page, date) to one row, positions as a 0-based sum. Anonymised queries go."""
    held = obs.filter(F.btrim(F.coalesce("query", F.lit(""))) != "")
    sums = F.sum((F.col("position") - 1) * F.col("impressions"))
    return held.groupBy("query", "page", "date").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), sums.alias("position_sum"))


def one_basis(rows: DataFrame) -> DataFrame:
    """Rows with either ``position`` or ``sum_position``: the 0-based sum. Rows of both kinds together, or of none, are an error."""
    basis = F.when(F.col("sum_position").isNotNull(), "sum").when(F.col("position").isNotNull(), "average")
    both = rows.select(basis.alias("b")).agg(F.count_distinct("b").alias("n"), F.sum(F.col("b").isNull().cast("int")).alias("none")).first()
    if both["n"] > 1 or both["none"]:
        raise ValueError("rows mix position bases, or have none")
    return rows.withColumn("position_sum", F.coalesce(F.col("sum_position").cast("double"), (F.col("position") - 1) * F.col("impressions")))


def path_of(page: Column) -> Column:
    return F.coalesce(F.try_parse_url(page, F.lit("PATH")), page)


def url_group(page: Column) -> Column:
    """First path segment, or (root)."""
    first = F.get(F.split(F.regexp_replace(path_of(page), "^/+", ""), "/"), F.lit(0))
    return F.when(first == "", F.lit("(root)")).otherwise(first)


def with_group(pages: DataFrame, corpus: DataFrame | None, col: str = "page") -> DataFrame:
    """``cluster`` of every page: the corpus's by url or by path, else the first path segment; and which of these it is."""
    own = url_group(F.col(col))
    if corpus is None:
        return pages.withColumn("cluster", own).withColumn("grouping", F.lit("url_path_segment"))
    by = corpus.select(F.col("url").alias("_url"), F.col("cluster").alias("_cluster")).dropDuplicates(["_url"])
    out = pages.join(by, F.col(col) == F.col("_url"), "left").withColumnRenamed("_cluster", "_c1").drop("_url")
    out = out.join(by, path_of(F.col(col)) == F.col("_url"), "left").withColumnRenamed("_cluster", "_c2").drop("_url")
    found = F.coalesce("_c1", "_c2")
    return out.withColumn("grouping", F.when(found.isNotNull(), "corpus_cluster").otherwise("url_path_segment")).withColumn("cluster", F.coalesce(found, own)).drop("_c1", "_c2")


def rates(pairs: DataFrame, curve: Mapping[int, float] | None, profiles: DataFrame | None, curves: Mapping[str, Mapping[int, float]] | None) -> DataFrame:
    """``pairs`` with ``ctr_expected``: from one curve, or from that of the query's result page (``profiles``: query, profile; others are ``clean``)."""
    if profiles is None:
        return pairs.withColumn("ctr_expected", expected_ctr(F.col("position"), curve))
    by = profiles.select(F.col("query").alias("_query"), F.col("profile").alias("_profile")).dropDuplicates(["_query"])
    held = pairs.join(by, F.col("query") == F.col("_query"), "left").withColumn("_profile", F.coalesce("_profile", F.lit("clean")))
    value = F.coalesce(*[F.when(F.col("_profile") == name, expected_ctr(F.col("position"), own)) for name, own in (curves or {}).items()], expected_ctr(F.col("position"), curve))
    return held.withColumn("ctr_expected", value).drop("_query", "_profile")


def striking(now: DataFrame, t: Thresholds, curve: Mapping[int, float] | None = None, profiles: DataFrame | None = None, curves: Mapping[str, Mapping[int, float]] | None = None) -> DataFrame:
    """Pairs within reach of the first places, by the clicks that they leave. The curve is one for all, or goes by the query's result page, see :func:`rates`."""
    t.reset()
    least, low, high, ceiling, cap = (t.get(f"striking.{k}") for k in ("min_impressions", "position_min", "position_max", "max_ctr", "result_cap"))
    pairs = rates(aggregate(now, "query", "page"), curve, profiles, curves)
    gap = F.col("ctr_expected") - F.col("ctr")
    kept = pairs.filter((F.col("impressions") >= least) & F.col("position").between(low, high) & (gap > 0))
    if ceiling is not None:
        kept = kept.filter(F.col("ctr") < ceiling)
    kept = kept.withColumn("opportunity_score", F.col("impressions") * gap)
    action = F.when(F.col("position") <= 7, "rewrite_title_and_meta").otherwise("strengthen_content_and_links")
    return kept.withColumn("action", action).orderBy(F.desc("opportunity_score"), "query", "page").limit(cap)


def ctr_outliers(now: DataFrame, t: Thresholds, curve: Mapping[int, float] | None = None, profiles: DataFrame | None = None, curves: Mapping[str, Mapping[int, float]] | None = None) -> DataFrame:
    t.reset()
    least, part, high = (t.get(f"ctr_outliers.{k}") for k in ("min_impressions", "ratio", "max_position"))
    pairs = rates(aggregate(now, "query", "page"), curve, profiles, curves)
    return pairs.filter((F.col("impressions") >= least) & (F.col("position") <= high) & (F.col("ctr") < part * F.col("ctr_expected")))


def decay(now: DataFrame, prior: DataFrame, t: Thresholds, corpus: DataFrame | None = None) -> DataFrame:
    """Pages that fell more than their cluster did."""
    t.reset()
    least, drop, margin, peers = (t.get(f"decay.{k}") for k in ("min_prior_clicks", "drop", "cluster_margin", "min_cluster_pages"))
    before = prior.groupBy("page").agg(F.sum("clicks").alias("clicks_prior")).filter("clicks_prior > 0")
    after = now.groupBy("page").agg(F.sum("clicks").alias("clicks_now"))
    moved = before.join(after, "page", "left").withColumn("clicks_now", F.coalesce("clicks_now", F.lit(0).cast("long")))
    moved = with_group(moved.withColumn("relative_change", (F.col("clicks_now") - F.col("clicks_prior")) / F.col("clicks_prior")), corpus)
    clusters = moved.groupBy("cluster").agg(F.median("relative_change").alias("cluster_median"), F.count(F.lit(1)).alias("cluster_pages"))
    out = moved.join(clusters, "cluster").withColumn("excess", F.col("relative_change") - F.col("cluster_median")).withColumn("differenced", F.col("cluster_pages") >= peers)
    return out.filter((F.col("clicks_prior") >= least) & (F.col("relative_change") <= drop) & (~F.col("differenced") | (F.col("excess") <= -margin)))


def rising(now: DataFrame, prior: DataFrame, t: Thresholds) -> DataFrame:
    t.reset()
    clicks, delta, least = (t.get(f"rising.{k}") for k in ("min_clicks_now", "min_delta_clicks", "min_impressions"))

    def scope(key: str) -> DataFrame:
        a = aggregate(now, key).filter((F.col(key) != "") & (F.col("clicks") >= clicks) & (F.col("impressions") >= least))
        b = prior.groupBy(key).agg(F.sum("clicks").alias("clicks_prior"))
        out = a.join(b, key, "left").filter(F.col("clicks_prior").isNull() | (F.col("clicks") - F.col("clicks_prior") >= delta))
        return out.select(F.lit(key).alias("scope"), F.col(key).alias("subject"), F.col("clicks").alias("clicks_now"), "clicks_prior", F.col("impressions").alias("impressions_now"), F.col("position").alias("position_now"))

    return scope("query").unionByName(scope("page"))


def lost(now: DataFrame, prior: DataFrame, t: Thresholds) -> DataFrame:
    t.reset()
    least, drop = t.get("lost.min_prior_impressions"), t.get("lost.drop")
    before = prior.filter(F.btrim("query") != "").groupBy("query").agg(F.sum("impressions").alias("impressions_prior")).filter(F.col("impressions_prior") >= least)
    after = now.groupBy("query").agg(F.sum("impressions").alias("impressions_now"))
    out = before.join(after, "query", "left").withColumn("impressions_now", F.coalesce("impressions_now", F.lit(0).cast("long")))
    out = out.withColumn("relative_change", (F.col("impressions_now") - F.col("impressions_prior")) / F.col("impressions_prior"))
    return out.filter((F.col("impressions_now") == 0) | (F.col("relative_change") <= drop))


def best_pages(now: DataFrame) -> DataFrame:
    """Best position of every query and its page; of equal ones the page that sorts first."""
    pairs = aggregate(now.filter(F.btrim("query") != ""), "query", "page")
    return pairs.groupBy("query").agg(F.sum("impressions").alias("impressions"), F.min(F.when(F.col("position").isNotNull(), F.struct("position", "page"))).alias("b")).filter("b is not null").select("query", "impressions", F.col("b.position").alias("best_position"), F.col("b.page").alias("best_page"))


def gaps(now: DataFrame, t: Thresholds) -> DataFrame:
    t.reset()
    least, place = t.get("gaps.min_impressions"), t.get("gaps.min_best_position")
    return best_pages(now).filter((F.col("impressions") >= least) & (F.col("best_position") > place))


def top_pages(now: DataFrame) -> DataFrame:
    """Page with most impressions of every query; of equal ones the page that sorts first."""
    pairs = now.filter(F.btrim("query") != "").groupBy("query", "page").agg(F.sum("impressions").alias("impressions"))
    return pairs.groupBy("query").agg(F.min(F.struct((-F.col("impressions")).alias("i"), "page")).alias("b")).select("query", F.col("b.page").alias("page"), (-F.col("b.i")).alias("impressions"))


def mismatch(now: DataFrame, intents: DataFrame, expected: DataFrame, t: Thresholds) -> DataFrame:
    """Top page whose intent isn't the query's. ``intents``: query, intent; ``expected``: page, intent (a url or a path)."""
    t.reset()
    least = t.get("mismatch.min_impressions")
    by = expected.select(F.col("page").alias("_page"), F.col("intent").alias("_i")).dropDuplicates(["_page"])
    out = top_pages(now).filter(F.col("impressions") >= least).join(intents.select("query", F.col("intent").alias("query_intent")), "query")
    out = out.join(by, F.col("page") == F.col("_page"), "left").withColumnRenamed("_i", "_a").drop("_page")
    out = out.join(by, path_of(F.col("page")) == F.col("_page"), "left").withColumn("page_intent", F.coalesce("_a", "_i")).drop("_page", "_a", "_i")
    return out.filter("query_intent <> page_intent")


def seasonality(obs: DataFrame, now: Span, t: Thresholds) -> DataFrame:
    """ISO weeks of the window with far fewer impressions than a year before. Short history is a row of its own, without a week."""
    t.reset()
    weeks, drop, least = (t.get(f"seasonality.{k}") for k in ("min_history_weeks", "residual_drop", "min_impressions"))
    iso = lambda c: (F.expr(f"extract(YEAROFWEEK FROM {c})").cast("int"), F.weekofyear(c))
    y, w = iso("date")
    by = obs.groupBy(y.alias("iso_year"), w.alias("iso_week")).agg(F.sum("impressions").alias("impressions"))
    days = obs.sparkSession.range((now[1] - now[0]).days + 1).select(F.date_add(F.lit(now[0]), F.col("id").cast("int")).alias("d"))
    y, w = iso("d")
    wanted = days.select(y.alias("iso_year"), w.alias("iso_week")).distinct()
    old = by.select((F.col("iso_year") + 1).alias("iso_year"), "iso_week", F.col("impressions").alias("impressions_year_ago"))
    pairs = by.join(F.broadcast(wanted), ["iso_year", "iso_week"]).join(old, ["iso_year", "iso_week"])
    pairs = pairs.withColumn("yoy_change", (F.col("impressions") - F.col("impressions_year_ago")) / F.col("impressions_year_ago"))
    found = pairs.filter((F.col("impressions_year_ago") >= least) & (F.col("yoy_change") <= drop))
    found = found.select(F.lit("dip").alias("status"), "iso_year", "iso_week", F.col("impressions").alias("impressions_now"), "impressions_year_ago", "yoy_change")
    span = obs.agg(F.datediff(F.max("date"), F.min("date")).alias("days"))
    short = span.filter(F.col("days") < weeks * 7).select(F.lit("insufficient_history").alias("status"), *[F.lit(None).cast(k).alias(c) for c, k in (("iso_year", "int"), ("iso_week", "int"), ("impressions_now", "long"), ("impressions_year_ago", "long"), ("yoy_change", "double"))])
    enough = span.filter(F.col("days") >= weeks * 7).select(F.lit("dip").alias("status"))
    return found.join(F.broadcast(enough), "status", "left_semi").unionByName(short)


def segmentation(obs: DataFrame, brand: Sequence[str], t: Thresholds) -> DataFrame:
    """Totals by segment. Without brand tokens there is no segment, and a blocking finding is due (see :func:`segmentation_gate`)."""
    part = F.when(branded(F.lower("query"), brand), "branded").otherwise("non_branded")
    return aggregate(obs.withColumn("segment", part), "segment")


def segmentation_gate(brand: Sequence[str], t: Thresholds) -> str | None:
    """Severity of the finding that no brand tokens are declared, or None."""
    t.reset()
    required = t.get("segmentation.require_brand_tokens")
    return None if brand else "BLOCK" if required else "INFO"


def first_impressions(obs: DataFrame) -> DataFrame:
    return obs.groupBy("page").agg(F.min("date").alias("first_date"))


def leading_indicators(obs: DataFrame, now: DataFrame, prior: DataFrame, span: Span, published: DataFrame, imported: Mapping[str, float | None] | None = None, cannibalized: DataFrame | None = None) -> DataFrame:
    """The eight indicators, one row each, always all: a null value has its reason. ``published``: url, published_at."""
    imported = imported or {}
    spark = obs.sparkSession
    pub = published.join(first_impressions(obs), F.col("url") == F.col("page"), "left")
    inside = F.col("published_at").between(F.lit(span[0]), F.lit(span[1]))
    one = pub.agg(F.round(F.try_divide(F.count(F.when(inside & F.col("first_date").isNotNull(), 1)).cast("double"), F.count(F.when(inside, 1)).cast("double")), 4).alias("v"))
    two = pub.filter("first_date >= published_at").agg(F.median(F.datediff("first_date", "published_at")).cast("int").cast("double").alias("v"))
    a, b = aggregate(now.filter(F.btrim("query") != ""), "query"), aggregate(prior, "query").select("query", F.col("position").alias("_before"))
    both = a.join(b, "query").filter("position is not null and _before is not null")
    three = both.agg(F.round(F.try_divide(F.sum((F.col("position") - F.col("_before")) * F.col("impressions")), F.sum("impressions").cast("double")), 3).alias("v"))
    four = best_pages(now).agg(F.round(F.avg((F.col("best_position") <= 20).cast("double")), 4).alias("v"))
    given = lambda k: spark.range(1).select(F.lit(imported.get(k)).cast("double").alias("v"))
    seven = cannibalized.filter("rule_id = 'LNK-25'").agg(F.count_distinct("query").cast("double").alias("v")) if cannibalized is not None else spark.range(1).select(F.lit(None).cast("double").alias("v"))
    rows = [
        ("LI-1_indexation_rate", one, "no pages published inside the window"), ("LI-2_days_to_first_impression_median", two, "no page has both a publication date and an impression"),
        ("LI-3_position_shift_weighted", three, "no query appears in both windows"), ("LI-4_visible_query_share", four, "no query carries a position in the window"),
        ("LI-5_ai_citation_rate", given("ai_citation_rate"), "not imported"), ("LI-6_defects_closed", given("defects_closed"), "not imported"),
        ("LI-7_cannibalized_queries", seven, "detector unavailable"), ("LI-8_rejection", given("rejection"), "not imported"),
    ]
    out = None
    for name, frame, why in rows:
        row = frame.select(F.lit(name).alias("indicator"), F.col("v").alias("value"), F.when(F.col("v").isNull(), why).alias("reason"))
        out = row if out is None else out.unionByName(row)
    return out


def visible_share(now: DataFrame, corpus: DataFrame | None = None) -> DataFrame:
    """Share of queries whose best position is among the first twenty, over all and by cluster of the best page."""
    placed = with_group(best_pages(now), corpus, "best_page")
    return placed.rollup("cluster").agg(F.round(F.avg((F.col("best_position") <= 20).cast("double")), 4).alias("visible_share"), F.count(F.lit(1)).alias("queries"))


def daily_leaders(collapsed: DataFrame) -> DataFrame:
    """Leading page of every query and day: best average position, then most impressions, then the page."""
    best = F.min(F.struct(F.try_divide(F.col("position_sum"), F.col("impressions").cast("double")).alias("p"), (-F.col("impressions")).alias("i"), "page"))
    return collapsed.groupBy("query", "date").agg(best.alias("b")).select("query", "date", F.col("b.page").alias("leader"))


def flip_rate(collapsed: DataFrame) -> DataFrame:
    """Changes of the leader between observed days over days less one; 0 with fewer than two days."""
    w = Window.partitionBy("query").orderBy("date")
    moved = daily_leaders(collapsed).withColumn("flip", (F.lag("leader").over(w) != F.col("leader")).cast("int"))
    out = moved.groupBy("query").agg(F.coalesce(F.sum("flip"), F.lit(0)).alias("flips"), F.count(F.lit(1)).alias("days"))
    return out.withColumn("flip_rate", F.when(F.col("days") < 2, 0.0).otherwise(F.col("flips") / (F.col("days") - 1)))


def cannibalization(obs: DataFrame, t: Thresholds, as_of: dt.date, embeddings: DataFrame | None = None, brand: Sequence[str] = ()) -> DataFrame:
    """Queries for which several pages compete, with the branch that is proposed. ``embeddings``: page, vector."""
    t.reset()
    urls, second, least, flips, merge, days, trim, strong = (t.get(f"cannibalization.{k}") for k in ("min_urls", "min_clicks_second_url", "min_impressions_per_pair", "flip_rate", "cosine_merge", "detect_window_days", "trim_days", "leader_dominance"))
    end = as_of - dt.timedelta(days=trim)
    rows = obs.filter((F.col("date") > F.lit(end - dt.timedelta(days=days))) & (F.col("date") <= F.lit(end)))
    rows = collapse(rows.filter(~branded(F.lower("query"), brand)) if brand else rows)
    pairs = rows.groupBy("query", "page").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions"), F.sum("position_sum").alias("position_sum")).filter(F.col("impressions") >= least)
    w = Window.partitionBy("query").orderBy(F.desc("clicks"), F.desc("impressions"), "page")
    ranked = pairs.withColumn("rn", F.row_number().over(w))
    at = lambda n, c: F.max(F.when(F.col("rn") == n, F.col(c)))
    top = ranked.groupBy("query").agg(F.count(F.lit(1)).alias("competing_urls"), at(1, "page").alias("leader"), at(2, "page").alias("runner_up"), at(1, "clicks").alias("leader_clicks"), at(2, "clicks").alias("runner_clicks"))
    top = top.filter((F.col("competing_urls") >= urls) & (F.col("runner_clicks") >= second))
    unstable = flip_rate(rows.join(pairs.select("query", "page"), ["query", "page"], "left_semi"))
    out = top.join(unstable, "query").withColumn("dominance", F.try_divide(F.col("leader_clicks").cast("double"), (F.col("leader_clicks") + F.col("runner_clicks")).cast("double")))
    if embeddings is not None:
        side = lambda c, v: embeddings.select(F.col("page").alias(c), F.col("vector").alias(v))
        out = out.join(side("leader", "_v1"), "leader", "left").join(side("runner_up", "_v2"), "runner_up", "left")
        out = out.withColumn("cosine_similarity", F.round(cosine(F.col("_v1"), F.col("_v2")), 6)).drop("_v1", "_v2")
    else:
        out = out.withColumn("cosine_similarity", F.lit(None).cast("double"))
    return out.withColumn("rule_id", F.when(F.col("flip_rate") < flips, "LNK-26").otherwise("LNK-25")).withColumn("proposed_branch", F.when(F.col("flip_rate") < flips, None).otherwise(branch(F.col("cosine_similarity"), F.col("dominance"), merge, strong)))


def branch(similarity: Column, dominance: Column, merge: float = 0.9, strong: float = 0.8) -> Column:
    """The tree as far as numbers go: without a cosine nothing is proposed."""
    return F.when(similarity < merge, "DIFFERENTIATE").when(similarity.isNotNull() & (dominance >= strong), "REDIRECT_301").when(similarity.isNotNull(), "CONSOLIDATE")


#: Severity and rule of each detector.
RULES = {"striking": ("MSR-23", "WARN"), "ctr_outliers": ("MSR-24", "WARN"), "decay": ("MSR-25", "WARN"), "rising": ("MSR-26", "INFO"), "mismatch": ("MSR-27", "WARN"), "lost": ("MSR-28", "WARN"), "gaps": ("MSR-31", "INFO"), "seasonality": ("MSR-29", "INFO"), "segmentation": ("MSR-04", "INFO"), "cannibalization": (None, "WARN")}
PREFIX = {"striking": "STRIKE", "ctr_outliers": "CTROUT", "decay": "DECAY", "rising": "RISING", "mismatch": "MISMATCH", "lost": "LOST", "gaps": "GAP", "cannibalization": "CANNIBAL", "seasonality": "SEASON", "segmentation": "SEGMENT"}


def findings(detected: Mapping[str, DataFrame], used: Mapping[str, Column] | None = None) -> DataFrame:
    """All detectors' rows in one shape: detector, rule_id, severity, subject, evidence (JSON), thresholds_used."""
    out = None
    for name, frame in detected.items():
        if name not in RULES:
            raise ValueError(f"unknown detector {name}")
        rule, severity = RULES[name]
        own = F.col("rule_id") if "rule_id" in frame.columns else F.lit(rule)  # competing pages name their rule
        if name == "seasonality":  # that the history is too short is a finding of another rule
            own = F.when(F.col("status") == "insufficient_history", "MSR-30").otherwise(rule)
        week = F.coalesce(F.concat(F.col("iso_year").cast("string"), F.lit("-W"), F.lpad(F.col("iso_week").cast("string"), 2, F.lit("0"))), F.lit("history")) if name == "seasonality" else None
        subject = week if name == "seasonality" else F.col("segment") if name == "segmentation" else F.concat_ws(" → ", "query", "page") if name in ("striking", "ctr_outliers", "mismatch") else F.col("subject") if name == "rising" else F.col("page") if name == "decay" else F.col("query")
        empty = F.array().cast("array<struct<key:string,value:string,source:string,note:string>>")
        row = frame.select(F.lit(name).alias("detector"), own.alias("rule_id"), F.lit(severity).alias("severity"), subject.alias("subject"), F.to_json(F.struct(*sorted(frame.columns))).alias("evidence"), (used or {}).get(name, empty).alias("thresholds_used"))
        out = row if out is None else out.unionByName(row)
    return out


def ordered(found: DataFrame, observe: bool = False) -> DataFrame:
    """Findings in report order with ids, of four digits or as many as they need; the order is total."""
    if observe:
        found = found.withColumn("severity", F.when(F.col("severity") == "BLOCK", "WARN").otherwise(F.col("severity")))
    rank = F.when(F.col("severity") == "BLOCK", 0).when(F.col("severity") == "WARN", 1).when(F.col("severity") == "INFO", 2).otherwise(F.raise_error(F.lit("unknown severity")).cast("int"))
    prefix = F.element_at(F.create_map(*[F.lit(x) for p in PREFIX.items() for x in p]), F.col("detector"))
    out = ordinal(found.withColumn("_rank", rank), "seq", *[F.col(c) for c in ("_rank", "rule_id", "subject", "evidence")])
    width = F.greatest(F.lit(4), F.length(F.col("seq").cast("string")))
    return out.withColumn("id", F.concat(prefix, F.lit("-"), F.lpad(F.col("seq").cast("string"), width, F.lit("0")))).drop("_rank")


def summarise(found: DataFrame) -> DataFrame:
    """Counts over all, by severity, by detector and by both in one pass."""
    found.createOrReplaceTempView("_larkspur_findings")
    return found.sparkSession.sql("SELECT detector, severity, count(*) AS n FROM _larkspur_findings GROUP BY GROUPING SETS ((), (severity), (detector), (detector, severity))")


def anonymised_share(obs: DataFrame) -> DataFrame:
    return obs.agg(F.round(F.coalesce(F.try_divide(F.sum(F.when(F.col("query") == "", F.col("impressions")).otherwise(0)).cast("double"), F.sum("impressions").cast("double")), F.lit(0.0)), 4).alias("anonymized_share"))


def history_mode(obs: DataFrame, t: Thresholds) -> DataFrame:
    days = F.datediff(F.max("date"), F.min("date")) + 1
    return obs.agg(days.alias("history_days"), F.when(days >= t.get("mode.steady_state_after_days"), "steady_state").otherwise("onboarding").alias("mode"))
