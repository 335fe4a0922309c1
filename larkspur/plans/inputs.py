"""Registered queries of checked inputs, gaps, refreshes, indicators and link gates, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.scores import CTR_CLEAN, ctr_curve
from larkspur.operators import graph as G
from larkspur.operators import inputs as I
from larkspur.operators import measure as M
from larkspur.operators import observations as O
from larkspur.operators import safety
from larkspur.plans.gate import _drafts, _PROSE, _RAW, toks
from larkspur.plans.queries import _TABLE, OBS, PAIRS, WINS, _clusters, now, obs, query, r, t
from larkspur.operators import drafts as D
from larkspur.thresholds import Thresholds

_AIO = _TABLE
for _k, _v in CTR_CLEAN.items():
    _AIO = _AIO.replace(f"WHEN p = {_k} THEN {_v}", f"WHEN p = {_k} THEN {_v * 0.39}")
_AIO = _AIO.replace("0.01 * pow(0.85", f"{CTR_CLEAN[10] * 0.39} * pow(0.85")
_PROFILED = f"(SELECT CAST(CASE WHEN aio THEN {_AIO} ELSE {_TABLE} END AS DOUBLE) FROM (SELECT greatest(1, CAST(round_even(position, 0) AS INTEGER)) AS p))"


def _profiles(spark, sf):
    brands = t(spark, sf, "part").select(F.col("p_brand").alias("query")).distinct()
    return brands.select("query", F.when(F.ascii(F.substring("query", -1, 1)) % 2 == 0, "aio").otherwise("clean").alias("profile"))


@query(f"WITH {OBS}, {WINS}, {PAIRS}, a AS (SELECT *, ascii(right(query, 1)) % 2 = 0 AS aio FROM pairs), c AS (SELECT *, {_PROFILED} AS ctr_expected FROM a) SELECT query, page, impressions, clicks, round(ctr, 6) AS ctr, round(ctr_expected, 6) AS ctr_expected FROM c WHERE impressions >= 50 AND position <= 10 AND ctr < 0.5 * ctr_expected")
def ctr_outliers_by_profile(spark, sf):
    out = O.ctr_outliers(now(spark, sf), Thresholds(), profiles=_profiles(spark, sf), curves={"aio": ctr_curve(aio=True), "clean": ctr_curve()})
    return out.select("query", "page", "impressions", "clicks", r("ctr"), r("ctr_expected"))


def _graph_queries(spark, sf):
    p = t(spark, sf, "part")
    k = F.col("p_partkey")
    rows = p.select(k.alias("id"), F.lower("p_name").alias("text_norm"), F.when(k % 3 == 0, "uk").otherwise("en").alias("lang"), F.lit("ua").alias("geo"), F.when(k % 4 == 0, "mobile").alias("device"), F.when(k % 5 != 0, k % 2 == 0).alias("is_verified"), F.when(k % 7 != 0, F.col("p_size")).alias("priority"), F.when(k % 2 == 0, "Informational").alias("intent_commercial"), F.lit("knowledge-seeking").alias("intent_cognitive"))
    priorities = p.filter("p_size > 25").select(k.alias("query_id"), (F.col("p_size") * 2).alias("priority"))
    intents = p.filter("p_size < 10").select(k.alias("query_id"), F.lit("transactional").alias("intent_commercial"), F.lit(" ").alias("intent_cognitive"))
    pillars = p.filter("p_size % 10 = 0").select(k.alias("query_id"), F.concat(F.lit("p"), (k % 6).cast("string")).alias("pillar_id"), F.lit("declared").alias("pillar_source"))
    return I.graph_queries(rows, priorities, intents, pillars)


_G = "g AS (SELECT p_partkey AS id, lower(p_name) AS text_norm, CASE WHEN p_partkey % 3 = 0 THEN 'uk' ELSE 'en' END AS lang, 'ua' AS geo, CASE WHEN p_partkey % 4 = 0 THEN 'mobile' ELSE 'desktop' END AS device, p_partkey % 5 <> 0 AND p_partkey % 2 = 0 AS is_verified, CAST(CASE WHEN p_size > 25 THEN p_size * 2 WHEN p_partkey % 7 <> 0 THEN p_size END AS DOUBLE) AS priority, CASE WHEN p_size < 10 THEN 'transactional' WHEN p_partkey % 2 = 0 THEN 'informational' END AS intent_commercial, 'knowledge' AS intent_cognitive, CASE WHEN p_size % 10 = 0 THEN 'p' || (p_partkey % 6) END AS pillar_id, CASE WHEN p_size % 10 = 0 THEN 'declared' END AS pillar_source FROM part)"


@query(f"WITH {_G} SELECT * FROM g")
def graph_queries(spark, sf):
    return _graph_queries(spark, sf)


@query(f"WITH {_G} SELECT lang || '-' || geo || '-' || device AS scope, count(*) AS queries, count(*) FILTER (WHERE is_verified) AS verified FROM g GROUP BY 1")
def query_scopes(spark, sf):
    return I.scopes(_graph_queries(spark, sf))


@query(f"WITH {_G} SELECT * FROM g WHERE lang = 'en' AND device = 'desktop'")
def scoped_queries(spark, sf):
    return I.scoped(_graph_queries(spark, sf), "en-ua-desktop")


@query(f"WITH {OBS} SELECT page, CAST(sum(impressions) AS BIGINT) AS impressions FROM obs WHERE NOT starts_with(page, '/s') AND NOT starts_with(page, '/e') GROUP BY page")
def unresolved_locales(spark, sf):
    held = obs(spark, sf).withColumn("locale", F.lit(None).cast("string"))
    return I.unresolved_locales(held, [{"prefix": "/s", "locale": "uk"}, {"prefix": "/e", "locale": "en"}], ["uk", "en"])


@query(f"WITH {OBS} SELECT CASE WHEN starts_with(page, '/s') THEN 'uk' ELSE 'en' END AS locale, CAST(sum(impressions) AS BIGINT) AS impressions FROM obs GROUP BY 1")
def locale_totals(spark, sf):
    held = I.with_locale(obs(spark, sf).withColumn("locale", F.lit(None).cast("string")), [{"prefix": "/s", "locale": "uk"}], ["en"])
    return held.groupBy("locale").agg(F.sum("impressions").alias("impressions"))


_SEC = "list_transform(regexp_split_to_array(raw, '(?m)^#{1,6}\\s+.*$'), lambda b: len(" + toks("b") + "))"


@query(f"WITH {_RAW}, s AS (SELECT draft, unnest({_SEC}) AS words, unnest(range(len({_SEC}))) AS pos FROM d) SELECT draft, CAST(pos AS INTEGER) AS pos, CAST(words AS INTEGER) AS words, CAST(coalesce(sum(words) OVER (PARTITION BY draft ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM s")
def section_offsets(spark, sf):
    from larkspur.functions.text import tokens

    sections = _drafts(spark, sf).select("draft", F.posexplode(F.transform(F.split("raw", "(?m)^#{1,6}\\s+.*$"), lambda b: F.size(tokens(b)))).alias("pos", "words"))
    return I.section_offsets(sections)


def _topics(spark, sf):
    k = F.col("c_custkey")
    some = lambda m: F.filter(F.array(*[F.when(k % i != 0, F.lit(f"x{i}")) for i in range(2, m)]), lambda x: x.isNotNull())
    whole = F.array(*[F.lit(f"x{i}") for i in range(2, 6)])
    date = lambda d: F.date_add(F.lit("2025-01-01").cast("date"), d.cast("int"))
    return t(spark, sf, "customer").select(k.alias("topic"), (k % 15 + 1).alias("their_position"), F.when(k % 4 != 0, k % 150).alias("our_position"), whole.alias("their_entities"), some(6).alias("our_entities"), (k % 9).alias("their_depth"), (k % 7).alias("our_depth"), F.array(F.lit("x2")).alias("wanted_formats"), some(4).alias("our_formats"), F.array(F.lit("x3")).alias("their_intents"), some(4).alias("our_intents"), date(k % 400).alias("their_updated"), date(k % 90).alias("our_updated"), (k % 2 == 0).alias("their_cited"), (k % 6 == 0).alias("our_cited"))


_HAVE = "k % 4 <> 0"


@query("WITH c AS (SELECT c_custkey AS k FROM customer) " + " UNION ALL ".join(f"SELECT k AS topic, '{name}' AS gap FROM c WHERE {test}" for name, test in {
    "keyword": f"k % 15 + 1 <= 10 AND (NOT {_HAVE} OR k % 150 > 100)", "entity": f"{_HAVE} AND (k % 2 = 0 OR k % 3 = 0 OR k % 5 = 0)", "depth": f"{_HAVE} AND k % 9 > k % 7", "format": "k % 2 = 0", "intent": f"{_HAVE} AND k % 3 = 0", "freshness": f"{_HAVE} AND k % 400 - k % 90 > 180", "citation": "k % 2 = 0 AND k % 6 <> 0",
}.items()))
def gap_types(spark, sf):
    return M.gap_types(_topics(spark, sf))


@query("WITH p AS (SELECT p_partkey AS k, p_retailprice AS price FROM part), a AS (SELECT k AS page, round(price * (k % 5) * ((k % 10) / 10.0), 6) AS score, CASE WHEN k % 11 = 0 THEN 'consolidation' WHEN k % 7 = 0 THEN 'competitive_threat' WHEN k % 3 = 0 AND k % 25 + 1 > 10 THEN 'foundation_rebuild' WHEN k % 25 + 1 <= 10 AND k % 4 = 0 THEN 'quick_win' END AS bucket, CASE WHEN k % 13 = 0 THEN 'freshness' WHEN k % 7 = 0 THEN 'competitive' WHEN k % 4 = 0 THEN 'urgent' WHEN k % 30 >= 24 THEN 'rewrite_or_delete' WHEN k % 30 >= 18 THEN 'full_refresh' WHEN k % 30 >= 12 THEN 'gap_analysis' WHEN k % 30 >= 6 THEN 'numbers' END AS trigger FROM p) SELECT page, score, bucket, trigger, coalesce(bucket IN ('consolidation', 'foundation_rebuild'), false) AS needs_approval FROM a WHERE bucket IS NOT NULL OR trigger IS NOT NULL")
def refresh_queue(spark, sf):
    k = F.col("p_partkey")
    return M.refresh_queue(t(spark, sf, "part").select(k.alias("page"), F.col("p_retailprice").alias("traffic"), (k % 5).alias("value"), ((k % 10) / 10).alias("efficiency"), (k % 25 + 1).alias("position"), F.when(k % 4 == 0, -0.2).otherwise(0.1).alias("decline"), (k % 7 == 0).alias("overtaken"), (k % 3 == 0).alias("volume_high"), (k % 11 == 0).alias("competing"), (k % 30).alias("age_months"), (k % 13 == 0).alias("citation_lost")))


@query("WITH a AS (SELECT round(sum(o_orderkey % 90) FILTER (WHERE o_orderstatus = 'F') / CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE), 6) AS htpi_published, round(sum(o_orderkey % 90) / CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS DOUBLE), 6) AS htpi_true, round(avg(CASE WHEN o_orderkey % 4 > 0 THEN 1.0 ELSE 0.0 END), 6) AS rework_rate, round(avg(o_orderkey % 4), 6) AS rework_iterations FROM orders), b AS (SELECT CAST(median(l_linenumber * 3) AS DOUBLE) AS days_to_merge, round(count(*) FILTER (WHERE l_returnflag = 'A') / CAST(count(*) AS DOUBLE), 6) AS confirmation_rate FROM lineitem), c AS (SELECT round(count(*) FILTER (WHERE p_size > 40) / CAST(count(*) AS DOUBLE), 6) AS churn FROM part) SELECT * FROM a, b, c")
def process_indicators(spark, sf):
    k = F.col("o_orderkey")
    drafts = t(spark, sf, "orders").select(k.alias("draft"), (k % 90).alias("minutes"), (F.col("o_orderstatus") == "F").alias("published"), (k % 4).alias("reworks"))
    day = F.to_date("l_shipdate")
    changes = t(spark, sf, "lineitem").select(day.alias("reached"), F.date_add(day, F.col("l_linenumber") * 3).alias("merged"), F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "R", "reverted").otherwise("inconclusive").alias("verdict"))
    rules = t(spark, sf, "part").select(F.col("p_partkey").alias("rule_id"), F.when(F.col("p_size") > 40, "modified").alias("change"))
    out = M.process_indicators(drafts, changes, rules)
    return out.select(*[r(c) for c in out.columns])


@query("WITH h AS (SELECT DISTINCT l_orderkey AS page, 'r' || l_linenumber AS rule_id, l_linenumber % 2 = 0 AS overridden FROM lineitem WHERE l_returnflag <> 'N'), p AS (SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, count(*) AS pages, CAST(sum(CASE WHEN a.overridden <> b.overridden THEN 1 ELSE 0 END) AS BIGINT) AS opposed FROM h a JOIN h b ON a.page = b.page AND a.rule_id < b.rule_id GROUP BY 1, 2) SELECT * FROM p WHERE pages >= 3 AND opposed = pages")
def conflicting_rules(spark, sf):
    n = F.col("l_linenumber")
    return M.conflicting_rules(t(spark, sf, "lineitem").select(F.concat(F.lit("r"), n.cast("string")).alias("rule_id"), F.col("l_orderkey").alias("page"), (F.col("l_returnflag") != "N").alias("fired"), (n % 2 == 0).alias("overridden")))


@query("SELECT p_partkey AS url, CAST(p_size AS INTEGER) AS raw_words, CAST(100 AS INTEGER) AS rendered_words FROM part WHERE p_size < 30")
def hidden_content(spark, sf):
    return M.hidden_content(t(spark, sf, "part").select(F.col("p_partkey").alias("url"), F.col("p_size").cast("int").alias("raw_words"), F.lit(100).alias("rendered_words")))


@query("SELECT round(avg(CASE WHEN CAST(o_orderdate AS DATE) = DATE '2001-01-01' THEN 1.0 ELSE 0.0 END), 6) AS today_share, avg(CASE WHEN CAST(o_orderdate AS DATE) = DATE '2001-01-01' THEN 1.0 ELSE 0.0 END) > 0.5 AS use_hash FROM orders")
def generated_timestamps(spark, sf):
    return M.generated_timestamps(t(spark, sf, "orders").select(F.col("o_orderdate").alias("updated_at")), "2001-01-01")


def _proposals(spark, sf):
    k, n = F.col("l_partkey"), F.col("l_suppkey")
    kind = lambda c: F.element_at(F.array(*[F.lit(x) for x in ("cluster", "pillar", "definition", "commercial")]), (c % 4 + 1).cast("int"))
    return t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("donor"), F.col("l_linenumber").alias("target"), (F.col("l_quantity") / 50 + 0.2).alias("similarity"), kind(k).alias("from_kind"), kind(n).alias("to_kind"), (k % 3 == 0).alias("same_cluster"), (k % 5 == 0).alias("priority_target"), (n % 2 == 0).alias("first_mention"), (n % 3 == 0).alias("same_intent"), ((k % 10) / 10).alias("position"), (n % 7).alias("anchor_targets"))


@query("WITH x AS (SELECT l_orderkey AS donor, l_linenumber AS target, l_quantity / 50 + 0.2 AS s, l_partkey AS k, l_suppkey AS n FROM lineitem), y AS (SELECT *, (k % 4 = 0 AND (n % 4 = 1 OR (n % 4 = 0 AND k % 3 = 0))) OR (k % 4 = 1 AND n % 4 = 0 AND k % 5 = 0) OR (n % 4 = 2 AND n % 2 = 0) OR (n % 4 = 3 AND n % 3 = 0) AS ok FROM x) SELECT coalesce(r, 'none') AS refused_by, count(*) AS links FROM (SELECT CASE WHEN s < 0.5 THEN 'noise' WHEN s < 0.78 THEN 'similarity' WHEN NOT ok THEN 'hierarchy' WHEN (k % 10) / 10.0 > 0.33 THEN 'position' WHEN n % 7 > 0 THEN 'anchor' END AS r FROM y) GROUP BY 1")
def link_gates(spark, sf):
    return G.link_gates(_proposals(spark, sf)).groupBy(F.coalesce("refused_by", F.lit("none")).alias("refused_by")).agg(F.count(F.lit(1)).alias("links"))


@query("WITH p AS (SELECT p_partkey AS k, p_size AS z FROM part), x AS (SELECT k AS page, CASE WHEN k % 6 = 0 OR z < 10 THEN 1 WHEN k % 7 > 3 THEN 2 WHEN k % 30 BETWEEN 5 AND 20 THEN 3 WHEN k % 5 = 0 THEN 4 WHEN k % 2 > 0 THEN 5 END AS tier FROM p) SELECT page, tier FROM x WHERE tier IS NOT NULL")
def link_priorities(spark, sf):
    k = F.col("p_partkey")
    return G.link_priorities(t(spark, sf, "part").select(k.alias("page"), (k % 6).alias("inlinks"), F.col("p_size").alias("link_score"), F.lit(10).alias("median_score"), (k % 7).alias("depth"), (k % 30).alias("position"), (k % 5 == 0).alias("conversion_high"), (k % 2).alias("external_links")))


@query("WITH e AS (SELECT vec_id, embedding FROM embeddings), p AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM e), m AS (SELECT list(a ORDER BY i) AS c FROM (SELECT i, avg(x) AS a FROM p GROUP BY i)), d AS (SELECT avg(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), c)) AS radius FROM e, m) SELECT round(radius, 5) AS radius, round(1 - radius, 5) AS focus FROM d")
def site_focus(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return G.site_focus(e).select(r("radius", 5), r("focus", 5))


@query("WITH a AS (SELECT c_custkey AS id, c_nationkey AS c FROM customer WHERE c_custkey % 9 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 99 ELSE c_nationkey END AS c FROM customer WHERE c_custkey % 8 <> 0), m AS (SELECT a.id AS id, a.c AS o, b.c AS n FROM a JOIN b ON a.id = b.id), x AS (SELECT p.id AS id, array_to_string(list_sort(list(q.id) FILTER (WHERE q.o = p.o AND q.n <> p.n)), ',') AS l, array_to_string(list_sort(list(q.id) FILTER (WHERE q.n = p.n AND q.o <> p.o)), ',') AS j FROM m p JOIN m q ON (q.o = p.o) <> (q.n = p.n) GROUP BY p.id) SELECT id, coalesce(l, '') AS \"left\", coalesce(j, '') AS joined FROM x")
def mates_changed(spark, sf):
    c = t(spark, sf, "customer")
    k = F.col("c_custkey")
    before = c.filter(k % 9 != 0).select(k.alias("id"), F.col("c_nationkey").alias("cluster_id"))
    after = c.filter(k % 8 != 0).select(k.alias("id"), F.when(k % 10 == 0, 99).otherwise(F.col("c_nationkey")).alias("cluster_id"))
    return G.mates_changed(before, after, lambda ids: F.array_join(ids, ","))


@query("WITH o AS (SELECT o_custkey % 50 AS project, 'K' || CAST(o_orderkey % 6 + 1 AS VARCHAR) AS k, CAST(o_orderdate AS DATE) AS day, o_orderstatus = 'F' AS raised, o_custkey % 3 <> 0 AND o_orderkey % 5 <> 0 AS whole FROM orders), g AS (SELECT project, k, max(day) FILTER (WHERE raised) AS raised_at, max(day) FILTER (WHERE NOT raised AND whole) AS f FROM o GROUP BY 1, 2) SELECT project, k AS \"trigger\", raised_at, CASE WHEN f > raised_at THEN f END AS released_at, f IS NULL OR f <= raised_at AS held FROM g WHERE raised_at IS NOT NULL")
def holds(spark, sf):
    k = F.col("o_orderkey")
    o = t(spark, sf, "orders").withColumns({"project": F.col("o_custkey") % 50, "trigger": F.concat(F.lit("K"), (k % 6 + 1).cast("string")), "at": F.to_date("o_orderdate")})
    text = F.lit("stated")
    who = F.when(F.col("o_custkey") % 3 != 0, "owner")
    pages = F.when(k % 5 != 0, F.array(F.lit("/a"))).otherwise(F.array().cast("array<string>"))
    lifted = o.filter("o_orderstatus <> 'F'").select("project", "trigger", "at", who.alias("released_by"), *[text.alias(c) for c in safety.STATED[1:]], pages.alias("urls"), F.col("at").alias("check_on"))
    return safety.holds(o.filter("o_orderstatus = 'F'").select("project", "trigger", "at"), lifted)
