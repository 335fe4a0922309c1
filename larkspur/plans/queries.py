"""The registered queries of the library over the driver's tables, one for each operator, and their SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.operators import content as C
from larkspur.operators import graph as G
from larkspur.operators import measure as M
from larkspur.operators import observations as O
from larkspur.sources import observations as S
from larkspur.sources import sinks
from larkspur.streaming import windows as T
from larkspur.thresholds import Thresholds

Query = Callable[[SparkSession, str], DataFrame]
AS_OF = dt.date(2001, 6, 30)
NOW, PRIOR = O.windows(AS_OF)
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        name = f.__name__.rstrip("_")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def obs(spark: SparkSession, sf: str, span: tuple[dt.date, dt.date] | None = None) -> DataFrame:
    """Line items as observations: the date range reaches the scan, parts are joined for the query and the page."""
    lines = t(spark, sf, "lineitem")
    if span:
        lines = lines.filter((F.col("l_shipdate") >= F.lit(span[0])) & (F.col("l_shipdate") < F.lit(span[1] + dt.timedelta(days=1))))
    rows = lines.join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    page = F.concat(F.lit("/"), F.lower("p_type"), F.lit("/s"), (F.col("l_suppkey") % 10).cast("string"))
    position = F.lit(1.0) + F.col("l_partkey") % 30 + (F.col("l_linenumber") - 1) / F.lit(8.0)
    return rows.select(F.to_date("l_shipdate").alias("date"), F.col("p_brand").alias("query"), page.alias("page"), F.floor(F.col("l_quantity") * F.col("l_discount")).cast("long").alias("clicks"), F.floor("l_quantity").cast("long").alias("impressions"), position.cast("double").alias("position")).filter("impressions > 0")


def now(spark, sf):
    return obs(spark, sf, NOW)


def prior(spark, sf):
    return obs(spark, sf, PRIOR)


OBS = """obs AS (SELECT CAST(l_shipdate AS DATE) AS date, p_brand AS query, '/' || lower(p_type) || '/s' || CAST(l_suppkey % 10 AS VARCHAR) AS page,
  CAST(floor(l_quantity * l_discount) AS BIGINT) AS clicks, CAST(floor(l_quantity) AS BIGINT) AS impressions,
  CAST(1.0 + (l_partkey % 30) + (l_linenumber - 1) / 8.0 AS DOUBLE) AS position FROM lineitem JOIN part ON l_partkey = p_partkey WHERE floor(l_quantity) > 0)"""
WINS = f"""now AS (SELECT * FROM obs WHERE date BETWEEN DATE '{NOW[0]}' AND DATE '{NOW[1]}'),
prior AS (SELECT * FROM obs WHERE date BETWEEN DATE '{PRIOR[0]}' AND DATE '{PRIOR[1]}')"""
PAIRS = """pairs AS (SELECT query, page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum(position * impressions) / sum(impressions) AS position,
  CAST(sum(clicks) AS DOUBLE) / sum(impressions) AS ctr FROM now GROUP BY query, page)"""
_TABLE = "CASE " + " ".join(f"WHEN p = {k} THEN {v}" for k, v in __import__("larkspur.functions.scores", fromlist=["CTR_CLEAN"]).CTR_CLEAN.items()) + " ELSE greatest(0.003, 0.01 * pow(0.85, p - 10)) END"


def expected(position: str) -> str:
    return f"(SELECT CAST({_TABLE} AS DOUBLE) FROM (SELECT greatest(1, CAST(round_even({position}, 0) AS INTEGER)) AS p))"


CASE = _TABLE.replace("p =", "bp =").replace("p - 10", "bp - 10")
CURVED = f"curved AS (SELECT *, CAST({CASE} AS DOUBLE) AS ctr_expected FROM (SELECT *, greatest(1, CAST(round_even(position, 0) AS INTEGER)) AS bp FROM pairs))"
R = "CAST(round({0}, {1}) AS DOUBLE)"


def r(name: str, digits: int = 6, alias: str | None = None):
    return F.round(name, digits).alias(alias or name)


@query(f"WITH {OBS} SELECT date, query, page, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round(sum(position * impressions) / sum(impressions), 4) AS position FROM obs GROUP BY date, query, page")
def obs_aggregate(spark, sf):
    return O.aggregate(obs(spark, sf), "date", "query", "page").select("date", "query", "page", "clicks", "impressions", r("position", 4))


@query(f"WITH {OBS}, {WINS}, {PAIRS} SELECT query, page, clicks, impressions, round(position, 6) AS position, round(ctr, 6) AS ctr FROM pairs")
def pair_aggregate(spark, sf):
    return O.aggregate(now(spark, sf), "query", "page").select("query", "page", "clicks", "impressions", r("position"), r("ctr"))


@query(f"WITH {OBS}, {WINS}, {PAIRS}, {CURVED} SELECT query, page, impressions, clicks, round(position, 4) AS position, round(ctr_expected, 6) AS ctr_expected, round(impressions * (ctr_expected - ctr), 4) AS opportunity_score, CASE WHEN position <= 7 THEN 'rewrite_title_and_meta' ELSE 'strengthen_content_and_links' END AS action FROM curved WHERE impressions >= 20 AND position BETWEEN 5 AND 20 AND ctr_expected > ctr ORDER BY impressions * (ctr_expected - ctr) DESC, query, page LIMIT 50")
def striking(spark, sf):
    out = O.striking(now(spark, sf), Thresholds())
    return out.select("query", "page", "impressions", "clicks", r("position", 4), r("ctr_expected"), r("opportunity_score", 4), "action")


@query(f"WITH {OBS}, {WINS}, {PAIRS}, {CURVED} SELECT query, page, impressions, clicks, round(position, 4) AS position, round(ctr, 6) AS ctr, round(ctr_expected, 6) AS ctr_expected FROM curved WHERE impressions >= 50 AND position <= 10 AND ctr < 0.5 * ctr_expected")
def ctr_outliers(spark, sf):
    return O.ctr_outliers(now(spark, sf), Thresholds()).select("query", "page", "impressions", "clicks", r("position", 4), r("ctr"), r("ctr_expected"))


LOWER = Thresholds({"decay": {"min_prior_clicks": 10}, "rising": {"min_clicks_now": 10, "min_delta_clicks": 5}, "lost": {"min_prior_impressions": 20, "drop": -0.2}, "gaps": {"min_best_position": 1.0}})


@query(f"""WITH {OBS}, {WINS}, b AS (SELECT page, CAST(sum(clicks) AS BIGINT) AS cp FROM prior GROUP BY page HAVING sum(clicks) > 0), a AS (SELECT page, CAST(sum(clicks) AS BIGINT) AS cn FROM now GROUP BY page),
m AS (SELECT b.page, cp, coalesce(cn, 0) AS cn, CAST(coalesce(cn, 0) - cp AS DOUBLE) / cp AS ch, string_split(b.page, '/')[2] AS cluster FROM b LEFT JOIN a ON a.page = b.page),
c AS (SELECT cluster, median(ch) AS med, count(*) AS n FROM m GROUP BY cluster)
SELECT page, m.cluster AS cluster, cp AS clicks_prior, CAST(cn AS BIGINT) AS clicks_now, round(ch, 6) AS relative_change, round(ch - med, 6) AS excess, n >= 3 AS differenced FROM m JOIN c ON m.cluster = c.cluster WHERE cp >= 10 AND ch <= -0.25 AND (n < 3 OR ch - med <= -0.15)""")
def decay(spark, sf):
    out = O.decay(now(spark, sf), prior(spark, sf), LOWER)
    return out.select("page", "cluster", "clicks_prior", "clicks_now", r("relative_change"), r("excess"), "differenced")


def _rising(key: str) -> str:
    return f"SELECT '{key}' AS scope, a.{key} AS subject, cn AS clicks_now, cp AS clicks_prior, im AS impressions_now FROM (SELECT {key}, CAST(sum(clicks) AS BIGINT) AS cn, CAST(sum(impressions) AS BIGINT) AS im FROM now GROUP BY {key}) a LEFT JOIN (SELECT {key}, CAST(sum(clicks) AS BIGINT) AS cp FROM prior GROUP BY {key}) b ON a.{key} = b.{key} WHERE a.{key} <> '' AND cn >= 10 AND im >= 30 AND (cp IS NULL OR cn - cp >= 5)"


@query(f"WITH {OBS}, {WINS} {_rising('query')} UNION ALL {_rising('page')}")
def rising(spark, sf):
    return O.rising(now(spark, sf), prior(spark, sf), LOWER).drop("position_now")


@query(f"WITH {OBS}, {WINS}, b AS (SELECT query, CAST(sum(impressions) AS BIGINT) AS ip FROM prior WHERE trim(query) <> '' GROUP BY query HAVING sum(impressions) >= 20), a AS (SELECT query, CAST(sum(impressions) AS BIGINT) AS im FROM now GROUP BY query), j AS (SELECT b.query, ip AS impressions_prior, CAST(coalesce(im, 0) AS BIGINT) AS impressions_now, CAST(coalesce(im, 0) - ip AS DOUBLE) / ip AS ch FROM b LEFT JOIN a ON a.query = b.query) SELECT query, impressions_prior, impressions_now, round(ch, 6) AS relative_change FROM j WHERE impressions_now = 0 OR ch <= -0.2")
def lost(spark, sf):
    return O.lost(now(spark, sf), prior(spark, sf), LOWER).select("query", "impressions_prior", "impressions_now", r("relative_change"))


@query(f"WITH {OBS}, {WINS}, {PAIRS} SELECT query, CAST(sum(impressions) AS BIGINT) AS impressions, round(min(position), 4) AS best_position, (list(page ORDER BY position, page))[1] AS best_page FROM pairs GROUP BY query HAVING sum(impressions) >= 30 AND min(position) > 1.0")
def gaps(spark, sf):
    return O.gaps(now(spark, sf), LOWER).select("query", "impressions", r("best_position", 4), "best_page")


INTENT = "CASE CAST(ascii(right({0}, 1)) AS INTEGER) % 3 WHEN 0 THEN 'informational' WHEN 1 THEN 'commercial' ELSE 'transactional' END"


def _intent(c):
    k = F.ascii(F.right(c, F.lit(1))) % 3
    return F.when(k == 0, "informational").when(k == 1, "commercial").otherwise("transactional")


@query(f"WITH {OBS}, {WINS}, tp AS (SELECT query, page, sum(impressions) AS i, row_number() OVER (PARTITION BY query ORDER BY sum(impressions) DESC, page) AS rn FROM now WHERE trim(query) <> '' GROUP BY query, page) SELECT query, page, CAST(i AS BIGINT) AS impressions, {INTENT.format('query')} AS query_intent, {INTENT.format('page')} AS page_intent FROM tp WHERE rn = 1 AND i >= 30 AND {INTENT.format('query')} <> {INTENT.format('page')}")
def mismatch(spark, sf):
    o = now(spark, sf)
    intents = o.select("query").distinct().withColumn("intent", _intent(F.col("query")))
    pages = o.select("page").distinct().withColumn("intent", _intent(F.col("page")))
    return O.mismatch(o, intents, pages, Thresholds()).select("query", "page", "impressions", "query_intent", "page_intent")


@query(f"WITH {OBS}, o AS (SELECT * FROM obs WHERE date <= DATE '{NOW[1]}'), w AS (SELECT CAST(extract(isoyear FROM date) AS INTEGER) AS y, CAST(extract(week FROM date) AS INTEGER) AS w, CAST(sum(impressions) AS BIGINT) AS i FROM o GROUP BY 1, 2), d AS (SELECT DISTINCT CAST(extract(isoyear FROM x) AS INTEGER) AS y, CAST(extract(week FROM x) AS INTEGER) AS w FROM (SELECT CAST(DATE '{NOW[0]}' + CAST(k AS INTEGER) AS DATE) AS x FROM (SELECT unnest(range(28)) AS k))) SELECT 'dip' AS status, a.y AS iso_year, a.w AS iso_week, a.i AS impressions_now, b.i AS impressions_year_ago, round(CAST(a.i - b.i AS DOUBLE) / b.i, 6) AS yoy_change FROM w a JOIN d ON a.y = d.y AND a.w = d.w JOIN w b ON b.y = a.y - 1 AND b.w = a.w WHERE b.i >= 100 AND CAST(a.i - b.i AS DOUBLE) / b.i <= -0.05")
def seasonality(spark, sf):
    out = O.seasonality(obs(spark, sf, (dt.date(1990, 1, 1), NOW[1])), NOW, Thresholds({"seasonality.residual_drop": -0.05}))
    return out.select("status", "iso_year", "iso_week", "impressions_now", "impressions_year_ago", r("yoy_change"))


@query(f"WITH {OBS}, {WINS} SELECT CASE WHEN contains(lower(query), '#1') THEN 'branded' ELSE 'non_branded' END AS segment, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, round(sum(position * impressions) / sum(impressions), 6) AS position, round(CAST(sum(clicks) AS DOUBLE) / sum(impressions), 6) AS ctr FROM now GROUP BY 1")
def segmentation(spark, sf):
    return O.segmentation(now(spark, sf), ["#1"], Thresholds()).select("segment", "clicks", "impressions", r("position"), r("ctr"))


FIRST = "first AS (SELECT page, min(date) AS fd FROM obs GROUP BY page), pub AS (SELECT DISTINCT page AS url, CAST(fd - CAST(3 + length(page) % 5 AS INTEGER) AS DATE) AS published_at FROM first)"


@query(f"""WITH {OBS}, {WINS}, {FIRST}, {PAIRS},
l2 AS (SELECT CAST(floor(median(date_diff('day', published_at, fd))) AS DOUBLE) AS v FROM pub JOIN first ON url = page WHERE fd >= published_at),
q1 AS (SELECT query, sum(impressions) AS i, sum(position * impressions) / sum(impressions) AS p FROM now GROUP BY query), q0 AS (SELECT query, sum(position * impressions) / sum(impressions) AS p FROM prior GROUP BY query),
l3 AS (SELECT round(sum((q1.p - q0.p) * q1.i) / sum(q1.i), 3) AS v FROM q1 JOIN q0 ON q1.query = q0.query),
l4 AS (SELECT round(avg(CASE WHEN b <= 20 THEN 1.0 ELSE 0.0 END), 4) AS v FROM (SELECT query, min(position) AS b FROM pairs GROUP BY query))
SELECT 'LI-1_indexation_rate' AS indicator, CAST(NULL AS DOUBLE) AS value, 'no pages published inside the window' AS reason
UNION ALL SELECT 'LI-2_days_to_first_impression_median', v, NULL FROM l2 UNION ALL SELECT 'LI-3_position_shift_weighted', CAST(v AS DOUBLE), NULL FROM l3 UNION ALL SELECT 'LI-4_visible_query_share', CAST(v AS DOUBLE), NULL FROM l4
UNION ALL SELECT 'LI-5_ai_citation_rate', NULL, 'not imported' UNION ALL SELECT 'LI-6_defects_closed', NULL, 'not imported' UNION ALL SELECT 'LI-7_cannibalized_queries', NULL, 'detector unavailable' UNION ALL SELECT 'LI-8_rejection', NULL, 'not imported'""")
def leading_indicators(spark, sf):
    every = obs(spark, sf)
    pub = O.first_impressions(every).select(F.col("page").alias("url"), F.date_sub("first_date", (3 + F.length("page") % 5)).alias("published_at"))
    return O.leading_indicators(every, now(spark, sf), prior(spark, sf), NOW, pub)


@query(f"WITH {OBS}, {WINS}, {PAIRS}, b AS (SELECT query, min(position) AS p, (list(page ORDER BY position, page))[1] AS page FROM pairs GROUP BY query), c AS (SELECT string_split(page, '/')[2] AS cluster, p FROM b) SELECT cluster, round(avg(CASE WHEN p <= 20 THEN 1.0 ELSE 0.0 END), 4) AS visible_share, count(*) AS queries FROM c GROUP BY ROLLUP(cluster)")
def visible_share(spark, sf):
    return O.visible_share(now(spark, sf))


DAYS = f"held AS (SELECT query, page, date, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions, sum((position - 1) * impressions) AS ps FROM obs WHERE trim(query) <> '' AND date > DATE '{NOW[1] - dt.timedelta(days=28)}' AND date <= DATE '{NOW[1]}' GROUP BY query, page, date)"
LEAD = "leaders AS (SELECT query, date, page AS leader FROM (SELECT *, row_number() OVER (PARTITION BY query, date ORDER BY ps / impressions, impressions DESC, page) AS rn FROM {0}) WHERE rn = 1), moved AS (SELECT query, CASE WHEN lag(leader) OVER (PARTITION BY query ORDER BY date) <> leader THEN 1 ELSE 0 END AS flip FROM leaders), flips AS (SELECT query, CAST(sum(flip) AS BIGINT) AS flips, count(*) AS days FROM moved GROUP BY query)"


@query(f"WITH {OBS}, {DAYS} SELECT query, page, date, clicks, impressions, round(ps, 4) AS position_sum FROM held")
def collapse_duplicates(spark, sf):
    return O.collapse(now(spark, sf)).select("query", "page", "date", "clicks", "impressions", r("position_sum", 4))


@query(f"WITH {OBS}, {DAYS}, {LEAD.format('held')} SELECT query, date, leader FROM leaders")
def daily_leaders(spark, sf):
    return O.daily_leaders(O.collapse(now(spark, sf)))


@query(f"WITH {OBS}, {DAYS}, {LEAD.format('held')} SELECT query, flips, days, CASE WHEN days < 2 THEN 0.0 ELSE round(CAST(flips AS DOUBLE) / (days - 1), 6) END AS flip_rate FROM flips")
def flip_rate(spark, sf):
    return O.flip_rate(O.collapse(now(spark, sf))).select("query", "flips", "days", r("flip_rate"))


def _vectors(spark, sf):
    """Vectors of pages: the embedding whose id is the page's length modulo 50."""
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    pages = now(spark, sf).select("page").distinct().withColumn("_v", (F.length("page") % 50).cast("long"))
    return pages.join(e, "_v").select("page", "vector")


@query(f"""WITH {OBS}, {DAYS}, agg AS (SELECT query, page, sum(clicks) AS clicks, sum(impressions) AS impressions FROM held GROUP BY query, page HAVING sum(impressions) >= 10),
rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY clicks DESC, impressions DESC, page) AS rn FROM agg),
top AS (SELECT query, count(*) AS n, max(CASE WHEN rn = 1 THEN page END) AS leader, max(CASE WHEN rn = 2 THEN page END) AS runner_up, max(CASE WHEN rn = 1 THEN clicks END) AS c1, max(CASE WHEN rn = 2 THEN clicks END) AS c2 FROM rk GROUP BY query),
comp AS (SELECT h.* FROM held h JOIN agg a ON a.query = h.query AND a.page = h.page), {LEAD.format('comp')},
e AS (SELECT vec_id, embedding FROM embeddings),
j AS (SELECT top.query, n, leader, runner_up, CAST(c1 AS DOUBLE) / (c1 + c2) AS dom, CASE WHEN days < 2 THEN 0.0 ELSE CAST(flips AS DOUBLE) / (days - 1) END AS fr, list_cosine_similarity(CAST(e1.embedding AS DOUBLE[]), CAST(e2.embedding AS DOUBLE[])) AS cs
 FROM top JOIN flips ON flips.query = top.query JOIN e e1 ON e1.vec_id = length(leader) % 50 JOIN e e2 ON e2.vec_id = length(runner_up) % 50 WHERE n >= 2 AND c2 >= 3)
SELECT query, n AS competing_urls, leader, runner_up, round(dom, 4) AS dominance, round(fr, 4) AS flip_rate, round(cs, 4) AS cosine_similarity, CASE WHEN fr < 0.3 THEN 'LNK-26' ELSE 'LNK-25' END AS rule_id,
 CASE WHEN fr < 0.3 THEN NULL WHEN cs < 0.9 THEN 'DIFFERENTIATE' WHEN dom >= 0.8 THEN 'REDIRECT_301' ELSE 'CONSOLIDATE' END AS proposed_branch FROM j""")
def cannibalization(spark, sf):
    out = O.cannibalization(obs(spark, sf, (NOW[0] - dt.timedelta(days=1), NOW[1])), Thresholds(), AS_OF, _vectors(spark, sf))
    return out.select("query", "competing_urls", "leader", "runner_up", r("dominance", 4), r("flip_rate", 4), r("cosine_similarity", 4), "rule_id", "proposed_branch")


def _found(spark, sf):
    n, p, th = now(spark, sf), prior(spark, sf), LOWER
    return O.findings({"striking": O.striking(n, th), "gaps": O.gaps(n, th), "lost": O.lost(n, p, th), "rising": O.rising(n, p, th), "decay": O.decay(n, p, th)})


@query()
def findings(spark, sf):
    return O.ordered(_found(spark, sf)).select("id", "seq", "detector", "rule_id", "severity", "subject")


@query()
def findings_summary(spark, sf):
    return O.summarise(_found(spark, sf))


@query(f"WITH {OBS} SELECT CAST(date_diff('day', min(date), max(date)) + 1 AS INTEGER) AS history_days, 'steady_state' AS mode FROM obs")
def history_mode(spark, sf):
    return O.history_mode(obs(spark, sf), Thresholds())


LOCALES = [{"prefix": "/economy", "locale": "uk"}, {"prefix": "/standard", "locale": "en"}, {"pattern": "^/promo", "locale": "de"}]


@query(f"WITH {OBS}, {WINS} SELECT CASE WHEN starts_with(page, '/economy') THEN 'uk' WHEN starts_with(page, '/standard') THEN 'en' WHEN starts_with(page, '/promo') THEN 'de' END AS locale, count(*) AS n, CAST(sum(impressions) AS BIGINT) AS impressions FROM now GROUP BY 1")
def locales_seen(spark, sf):
    return now(spark, sf).groupBy(S.locale_of(F.col("page"), LOCALES).alias("locale")).agg(F.count(F.lit(1)).alias("n"), F.sum("impressions").alias("impressions"))


@query(f"WITH {OBS}, {WINS} SELECT '{NOW[0]}' AS start, '{NOW[1]}' AS \"end\", 4 AS trimmed_days, count(*) AS row_count, round(CAST(sum(CASE WHEN query = 'Brand#11' THEN impressions ELSE 0 END) AS DOUBLE) / sum(impressions), 4) AS anonymized_share, CAST(count(*) FILTER (WHERE NOT starts_with(page, '/economy') AND NOT starts_with(page, '/standard') AND NOT starts_with(page, '/promo')) AS BIGINT) AS unmapped, count(*) FILTER (WHERE NOT starts_with(page, '/economy') AND NOT starts_with(page, '/standard') AND NOT starts_with(page, '/promo')) = 0 AS usable FROM now")
def manifest(spark, sf):
    rows = now(spark, sf).withColumn("locale", S.locale_of(F.col("page"), LOCALES)).withColumn("is_anonymized", F.col("query") == "Brand#11")
    return sinks.manifest(rows, str(NOW[0]), str(NOW[1])).drop("locales_seen")


@query(f"WITH {OBS}, {WINS}, k AS (SELECT DISTINCT 'l' || CAST(length(page) % 2 AS VARCHAR) AS locale, query, page, position FROM now), b AS (SELECT locale, query, page AS domain, min(position) AS position FROM k GROUP BY locale, query, page), tot AS (SELECT locale, count(DISTINCT query) AS total FROM k GROUP BY locale), s AS (SELECT *, greatest(1, CAST(round_even(position, 0) AS INTEGER)) AS bp FROM b) SELECT s.locale AS locale, domain, count(*) AS queries, round(sum(CAST({CASE} AS DOUBLE)) / max(total), 6) AS sov FROM s JOIN tot ON s.locale = tot.locale GROUP BY s.locale, domain")
def share_of_voice(spark, sf):
    serps = now(spark, sf).select(F.concat(F.lit("l"), (F.length("page") % 2).cast("string")).alias("locale"), "query", F.col("page").alias("domain"), "position", F.lit(1.0).alias("weight"))
    return M.share_of_voice(serps).select("locale", "domain", "queries", r("sov"))


MID = CASE.replace("bp", "mp")


@query(f"WITH {OBS}, b AS (SELECT *, CAST(round_even(position, 0) AS INTEGER) AS q FROM obs WHERE query <> ''), c AS (SELECT CASE WHEN q BETWEEN 1 AND 10 THEN q WHEN q BETWEEN 11 AND 15 THEN 11 WHEN q BETWEEN 16 AND 20 THEN 16 END AS bucket, CAST(sum(clicks) AS BIGINT) AS clicks, CAST(sum(impressions) AS BIGINT) AS impressions FROM b WHERE q BETWEEN 1 AND 20 GROUP BY 1 HAVING sum(impressions) >= 1000), d AS (SELECT *, CASE bucket WHEN 11 THEN 13 WHEN 16 THEN 18 ELSE bucket END AS mp, CAST(clicks AS DOUBLE) / impressions AS own, least(1.0, impressions / 10000.0) AS w FROM c) SELECT bucket, clicks, impressions, round(own, 6) AS ctr_own, round(CAST({MID} AS DOUBLE), 6) AS ctr_prior, round(CAST(w AS DOUBLE), 4) AS w, round(w * own + (1 - w) * CAST({MID} AS DOUBLE), 6) AS ctr_final, w < 0.3 AS provisional FROM d")
def ctr_calibration(spark, sf):
    return M.calibrate_ctr(obs(spark, sf)).select("bucket", "clicks", "impressions", r("ctr_own"), r("ctr_prior"), r("w", 4), r("ctr_final"), "provisional")


COH = f"f AS (SELECT page, min(date) AS fd FROM obs GROUP BY page), pg AS (SELECT page, CASE WHEN length(page) % 3 = 0 THEN 'control' ELSE '2001-0' || CAST(length(page) % 3 AS VARCHAR) END AS cohort FROM f), sz AS (SELECT cohort, count(*) AS pages FROM pg GROUP BY cohort), wk AS (SELECT cohort, CAST(date_trunc('week', date) AS DATE) AS week, sum(clicks) AS clicks FROM obs JOIN pg ON pg.page = obs.page WHERE date BETWEEN DATE '{PRIOR[0]}' AND DATE '{NOW[1]}' GROUP BY 1, 2), cpp AS (SELECT wk.cohort, week, CAST(clicks AS BIGINT) AS clicks, CAST(clicks AS DOUBLE) / pages AS c FROM wk JOIN sz ON sz.cohort = wk.cohort), dl AS (SELECT *, (c - lag(c) OVER (PARTITION BY cohort ORDER BY week)) / nullif(lag(c) OVER (PARTITION BY cohort ORDER BY week), 0) AS delta FROM cpp), rd AS (SELECT a.cohort, a.week, a.clicks, a.c, a.delta, a.delta - b.delta AS rel FROM dl a LEFT JOIN dl b ON b.cohort = 'control' AND b.week = a.week WHERE a.cohort <> 'control')"


def _cohorts(spark, sf):
    first = O.first_impressions(obs(spark, sf)).select("page")
    day = F.when(F.length("page") % 3 == 0, F.lit(dt.date(2000, 1, 1))).otherwise(F.make_date(F.lit(2001), F.length("page") % 3, F.lit(1)))
    return M.cohort_weeks(obs(spark, sf, (PRIOR[0], NOW[1])), first.withColumn("first_date", day), "2001-01-01")


@query(f"WITH {OBS}, {COH} SELECT cohort, week, clicks, round(c, 6) AS clicks_per_page, round(delta, 6) AS delta, round(rel, 6) AS rel_delta FROM rd")
def cohort_watch(spark, sf):
    return _cohorts(spark, sf).select("cohort", "week", "clicks", r("clicks_per_page"), r("delta"), r("rel_delta"))


@query(f"WITH {OBS}, {COH}, al AS (SELECT *, lag(rel) OVER (PARTITION BY cohort ORDER BY week) AS pr FROM rd), lv AS (SELECT cohort, week, CASE WHEN rel <= -0.4 OR (pr IS NOT NULL AND greatest(rel, pr) <= -0.3) THEN 'alarm' WHEN pr IS NOT NULL AND rel IS NOT NULL AND greatest(rel, pr) <= -0.15 THEN 'watch' END AS level FROM al) SELECT cohort, week, level FROM lv WHERE level IS NOT NULL")
def cohort_alerts(spark, sf):
    return M.cohort_alerts(_cohorts(spark, sf)).select("cohort", "week", "level")


# --- text -----------------------------------------------------------------

TOK = "regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{Nl}\\p{No}]+(?:[’''ʼ\\-][\\p{L}\\p{Nl}\\p{No}]+)*|\\p{Nd}+(?:[.,]\\p{Nd}+)*')"


@query(f"SELECT doc_id, CAST(len({TOK}) AS INTEGER) AS n_tokens, CAST(len(list_distinct({TOK})) AS INTEGER) AS n_distinct FROM documents")
def token_counts(spark, sf):
    return C.token_counts(t(spark, sf, "documents"))


@query()
def sentence_stats(spark, sf):
    return C.sentence_stats(t(spark, sf, "documents")).select("doc_id", "sentences", r("sigma"), r("mid_share"))


@query(f"WITH w AS (SELECT doc_id, unnest({TOK}) AS w, unnest(range(len({TOK}))) AS p FROM documents), c AS (SELECT doc_id, p // 500 AS k, count(*) AS n, count(DISTINCT w) AS d FROM w GROUP BY 1, 2 HAVING count(*) >= 50) SELECT doc_id, round(min(CAST(d AS DOUBLE) / n), 6) AS min_ttr, count(*) AS chunks FROM c GROUP BY doc_id")
def type_token_ratio(spark, sf):
    return C.type_token_ratio(t(spark, sf, "documents")).select("doc_id", r("min_ttr"), "chunks")


@query()
def repeated_openers(spark, sf):
    return C.repeated_openers(t(spark, sf, "documents")).select("doc_id", "sentences", r("repeated_share"))


@query()
def paragraph_mode(spark, sf):
    return C.paragraph_mode(t(spark, sf, "documents")).select("doc_id", "mode", "paragraphs", r("uniform_share"))


@query(f"WITH a AS (SELECT doc_id, {TOK} AS w FROM documents), b AS (SELECT item_id, {TOK} AS w FROM benchmark), ga AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM a WHERE len(w) >= 8)), gb AS (SELECT DISTINCT item_id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)), n AS (SELECT doc_id, count(*) AS n_grams FROM ga GROUP BY doc_id) SELECT ga.doc_id AS doc_id, item_id, count(*) AS shared, CAST(max(n_grams) AS INTEGER) AS n_grams, round(CAST(count(*) AS DOUBLE) / max(n_grams), 6) AS overlap FROM ga JOIN gb ON ga.g = gb.g JOIN n ON n.doc_id = ga.doc_id GROUP BY ga.doc_id, item_id")
def ngram_overlap(spark, sf):
    return C.ngram_overlap(t(spark, sf, "documents"), t(spark, sf, "benchmark")).select("doc_id", "item_id", "shared", "n_grams", r("overlap"))


ENTITIES = ["the", "apache license", "nicht", "pour", "with"]


@query("WITH a AS (SELECT doc_id, ' ' || array_to_string(" + TOK + ", ' ') || ' ' AS w FROM documents), e AS (SELECT unnest(['the', 'apache license', 'nicht', 'pour', 'with']) AS e), d AS (SELECT e AS entity, count(*) AS df FROM a, e WHERE contains(w, ' ' || e || ' ') GROUP BY e) SELECT entity, df FROM d WHERE df * 2 >= (SELECT count(*) FROM documents)")
def core_entities(spark, sf):
    return C.core_entities(C.entity_coverage(t(spark, sf, "documents"), ENTITIES))


# Fixed values, as in the text functions.
_MARKS = "contentReference|oai_citation|turn\\d+search\\d+|attributableIndex|\\[cite:\\s*\\d+\\]|\\[span_\\d+\\]\\(start_span\\)|grok_card|ppl-ai-file-upload|attached_file|:::writing"
_UTM = "utm_source=chatgpt\\.com|utm_source=openai|utm_source=perplexity"
_UNSEEN = "[\\x{200B}\\x{200C}\\x{200D}\\x{2060}\\x{FEFF}\\x{202F}\\x{00AD}\\x{2061}]"
_SCRIPTS = "regexp_matches(w, '[\\x{0400}-\\x{052F}\\x{2DE0}-\\x{2DFF}\\x{A640}-\\x{A69F}]') AND regexp_matches(w, '[A-Za-z\\x{00C0}-\\x{024F}]')"


@query(f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_MARKS}')) AS INTEGER) AS tool_marks, CAST(len(regexp_extract_all(text, '{_UTM}')) AS INTEGER) AS tracking, CAST(len(regexp_extract_all(text, '{_UNSEEN}')) AS INTEGER) AS invisible, CAST(len(list_filter(regexp_extract_all(text, '\\p{{L}}+'), lambda w: {_SCRIPTS})) AS INTEGER) AS mixed_script FROM documents")
def text_markers(spark, sf):
    return C.markers(t(spark, sf, "documents"))


PACK = [{"set": "stop", "phrase": "licensed under", "severity": "BLOCK"}, {"set": "stop", "phrase": "idiot"}, {"set": "openers", "phrase": "the and"}]


@query()
def pack_density(spark, sf):
    return C.pack_hits(t(spark, sf, "documents"), PACK).select("doc_id", "set", "phrase", "severity", "n_words", "hits", r("per_1000", 4))


@query("WITH r AS (SELECT CAST(l.doc_id % 50 AS BIGINT) AS draft, 'WRT-' || CAST(10 + l.doc_id % 7 AS VARCHAR) AS rule_id, CASE WHEN l.doc_id % 3 = 0 THEN 'BLOCK' ELSE 'WARN' END AS severity, CASE WHEN toxic = 1 THEN 'fail' WHEN quality = 0 THEN 'requires_agent' ELSE 'pass' END AS status FROM labels l), v AS (SELECT draft, count(DISTINCT CASE WHEN status = 'fail' AND severity = 'BLOCK' THEN rule_id END) AS b, count(*) FILTER (WHERE status = 'fail' AND severity = 'WARN') AS warned, count(*) FILTER (WHERE status = 'requires_agent') AS unresolved FROM r GROUP BY draft) SELECT draft, CAST(b AS INTEGER) AS n_blocked, warned, unresolved, CASE WHEN b > 0 THEN 'BLOCK' WHEN unresolved > 0 OR warned >= 2 THEN 'REWORK' ELSE 'PASS' END AS verdict FROM v")
def draft_verdict(spark, sf):
    rule = F.concat(F.lit("WRT-"), (10 + F.col("doc_id") % 7).cast("string"))
    status = F.when(F.col("toxic") == 1, "fail").when(F.col("quality") == 0, "requires_agent").otherwise("pass")
    rows = t(spark, sf, "labels").select((F.col("doc_id") % 50).alias("draft"), rule.alias("rule_id"), F.when(F.col("doc_id") % 3 == 0, "BLOCK").otherwise("WARN").alias("severity"), status.alias("status"))
    return C.verdict(rows).select("draft", F.size("blocked_by").alias("n_blocked"), "warned", "unresolved", "verdict")


# --- graph ----------------------------------------------------------------


def _serps(spark, sf):
    """Suppliers of each part, most quantity first, as result pages of parts."""
    by = t(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    w = Window.partitionBy("l_partkey").orderBy(F.desc("q"), "l_suppkey")
    top = by.withColumn("rn", F.row_number().over(w)).filter("rn <= 10")
    return top.groupBy(F.col("l_partkey").alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", F.col("l_suppkey").cast("string").alias("s")))), lambda x: x["s"]).alias("urls"))


SERP = "byq AS (SELECT l_partkey AS id, l_suppkey AS s, row_number() OVER (PARTITION BY l_partkey ORDER BY sum(l_quantity) DESC, l_suppkey) AS rn FROM lineitem GROUP BY l_partkey, l_suppkey), top AS (SELECT id, s FROM byq WHERE rn <= 10), edges AS (SELECT a.id AS a, b.id AS b, CAST(count(*) AS INTEGER) AS serp_overlap FROM top a JOIN top b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2)"


@query(f"WITH {SERP} SELECT a, b, serp_overlap FROM edges WHERE serp_overlap >= 3")
def serp_edges(spark, sf):
    return G.serp_edges(_serps(spark, sf), least=3)


def _queries(spark, sf):
    p = t(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("text_norm"), F.col("p_size").cast("double").alias("priority"), F.col("p_retailprice").alias("volume"))


def _clusters(spark, sf, *thresholds):
    """Clusters by each threshold, from one set of edges."""
    q = _queries(spark, sf)
    edges = G.cut(G.serp_edges(_serps(spark, sf), least=min(thresholds)))
    return [G.centroid_clusters(q, edges, x) for x in thresholds]


@query()
def centroid_clusters(spark, sf):
    return _clusters(spark, sf, 3)[0]


@query()
def cluster_drift(spark, sf):
    return G.drift_summary(*(G.cut(x.select("id", "cluster_id")) for x in _clusters(spark, sf, 3, 4)))


@query("WITH m AS (SELECT c_nationkey AS cluster_id, CASE c_custkey % 3 WHEN 0 THEN 'informational' WHEN 1 THEN 'transactional' ELSE 'commercial' END AS co, CASE WHEN c_custkey % 2 = 0 THEN 'knowledge' ELSE 'output' END AS cg FROM customer), b AS (SELECT cluster_id, count(*) AS size, bool_or(co = 'informational') AND bool_or(co = 'transactional') AS x, bool_or(cg = 'knowledge') AND bool_or(cg = 'output') AS y FROM m GROUP BY cluster_id) SELECT cluster_id, size, 'SEM-10' AS rule_id, 'commercial' AS why FROM b WHERE x UNION ALL SELECT cluster_id, size, 'SEM-10', 'cognitive' FROM b WHERE y UNION ALL SELECT cluster_id, size, 'SEM-23', 'size' FROM b WHERE size > 12")
def over_merging(spark, sf):
    k = F.col("c_custkey")
    rows = t(spark, sf, "customer").select(F.col("c_nationkey").alias("cluster_id"), F.when(k % 3 == 0, "informational").when(k % 3 == 1, "transactional").otherwise("commercial").alias("commercial"), F.when(k % 2 == 0, "knowledge").otherwise("output").alias("cognitive"))
    return G.over_merged(rows, 12)


def _links(spark, sf):
    """Links of the pages' markup: source page, target path, anchor, zone."""
    p = t(spark, sf, "pages")
    one = p.select("page_id", F.regexp_extract(F.col("url"), "/(fr|en|de|es)/", 1).alias("locale"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)">([^<]*)</a>'), F.lit(0))).alias("tag"))
    return one.select("page_id", "locale", F.regexp_extract("tag", 'href="([^"]*)"', 1).alias("dst"), F.lower(F.regexp_extract("tag", ">([^<]*)<", 1)).alias("anchor")).withColumn("anchor_type", F.when(F.col("dst") == F.concat(F.lit("/"), F.col("anchor")), "exact").otherwise("partial"))


LINKS = """tags AS (SELECT page_id, regexp_extract(url, '/(fr|en|de|es)/', 1) AS locale, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>')) AS tag FROM pages), links AS (SELECT page_id, locale, regexp_extract(tag, 'href="([^"]*)"', 1) AS dst, lower(regexp_extract(tag, '>([^<]*)<', 1)) AS anchor FROM tags)"""


@query(f"WITH {LINKS} SELECT dst, count(*) AS links, count(DISTINCT anchor) AS anchors, round(avg(CASE WHEN dst = '/' || anchor THEN 1.0 ELSE 0.0 END), 6) AS exact_share, round(CAST(count(DISTINCT anchor) AS DOUBLE) / count(*), 6) AS diversity FROM links GROUP BY dst")
def anchor_registry(spark, sf):
    return G.anchors(_links(spark, sf)).select("dst", "links", "anchors", r("exact_share"), r("diversity"))


@query(f"WITH {LINKS} SELECT locale, anchor, count(DISTINCT dst) AS targets FROM links GROUP BY locale, anchor HAVING count(DISTINCT dst) > 1")
def ambiguous_anchors(spark, sf):
    return G.ambiguous_anchors(_links(spark, sf))


def _edges(spark, sf):
    """Parts linked to suppliers and back, as a link graph."""
    li = t(spark, sf, "lineitem")
    a = li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))
    b = li.filter("l_quantity > 25").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return a.unionByName(b).distinct()


@query("""WITH RECURSIVE e AS (SELECT DISTINCT * FROM (SELECT 'p' || CAST(l_partkey AS VARCHAR) AS src, 's' || CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem UNION ALL SELECT 's' || CAST(l_suppkey AS VARCHAR), 'p' || CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity > 25)), b AS (SELECT 'p1' AS node, 0 AS depth UNION SELECT e.dst, b.depth + 1 FROM b JOIN e ON e.src = b.node WHERE b.depth < 6) SELECT node, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY node""")
def click_depth(spark, sf):
    return G.click_depth(_edges(spark, sf), "p1")


@query()
def page_rank(spark, sf):
    return G.page_rank(_edges(spark, sf)).select("node", r("rank", 8), r("link_score", 4))


@query("WITH v AS (SELECT CAST(l_extendedprice AS DOUBLE) AS x FROM lineitem), o AS (SELECT x, row_number() OVER (ORDER BY x) AS i FROM v) SELECT round(2 * sum(i * x) / (count(*) * sum(x)) - CAST(count(*) + 1 AS DOUBLE) / count(*), 6) AS gini, count(*) AS n FROM o")
def link_gini(spark, sf):
    return G.gini(t(spark, sf, "lineitem"), "l_extendedprice").select(r("gini"), "n")


@query("WITH pg AS (SELECT s_suppkey AS page, s_nationkey AS depth FROM supplier WHERE s_suppkey % 7 <> 0), i AS (SELECT l_suppkey AS page, count(*) AS n FROM lineitem GROUP BY 1), j AS (SELECT pg.page, depth, coalesce(n, 0) AS n FROM pg LEFT JOIN i ON i.page = pg.page) SELECT count(*) AS pages, round(avg(CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END), 6) AS orphan_rate, quantile_cont(depth, 0.5) AS depth_p50, quantile_cont(depth, 0.9) AS depth_p90, round(avg(CASE WHEN depth > 3 THEN 1.0 ELSE 0.0 END), 6) AS share_deeper_3, round(avg(CASE WHEN depth > 5 THEN 1.0 ELSE 0.0 END), 6) AS share_deeper_5, quantile_cont(n, 0.1) AS inlinks_p10, round(avg(CASE WHEN n < 3 THEN 1.0 ELSE 0.0 END), 6) AS share_inlinks_lt_3 FROM j")
def link_health(spark, sf):
    pages = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("page"), F.col("s_nationkey").alias("depth"), (F.col("s_suppkey") % 7 != 0).alias("indexable"))
    links = t(spark, sf, "lineitem").select((-F.col("l_orderkey")).alias("src"), F.col("l_suppkey").alias("dst"))
    out = G.link_health(pages, links)
    return out.select("pages", r("orphan_rate"), "depth_p50", "depth_p90", r("share_deeper_3"), r("share_deeper_5"), "inlinks_p10", r("share_inlinks_lt_3"))


@query("WITH d AS (SELECT l_suppkey AS dst, CAST(l_shipdate AS DATE) AS created, count(*) AS made FROM lineitem GROUP BY 1, 2) SELECT dst, created, made, CAST(sum(made) OVER (PARTITION BY dst ORDER BY created RANGE BETWEEN INTERVAL 89 DAY PRECEDING AND CURRENT ROW) AS BIGINT) AS made_in_window FROM d")
def rolling_links(spark, sf):
    links = t(spark, sf, "lineitem").select(F.col("l_suppkey").alias("dst"), F.to_date("l_shipdate").alias("created"))
    return G.rolling_links(links, 90)


@query("WITH u AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM u GROUP BY i)) SELECT vec_id, round(1 - list_cosine_similarity(CAST(embedding AS DOUBLE[]), c), 5) AS radius FROM embeddings, c")
def site_radius(spark, sf):
    v = t(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return G.site_radius(v, "vec_id").select("vec_id", r("radius", 5))


@query("SELECT a.vec_id AS donor, b.vec_id AS target, CAST(a.label AS INTEGER) AS cluster, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.3")
def link_candidates(spark, sf):
    e = t(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vector"))
    return G.link_candidates(e, e, least=0.3).select("donor", "target", "cluster", r("similarity", 4))


# --- trends, answers, logs ------------------------------------------------


def _series(spark, sf):
    e = t(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("term"), F.to_date("ts").alias("date")).agg(F.count(F.lit(1)).alias("value"))


SERIES = "s AS (SELECT event_type AS term, CAST(ts AS DATE) AS date, count(*) AS value FROM events GROUP BY 1, 2)"


@query(f"WITH {SERIES}, j AS (SELECT a.term, a.date, a.value, median(b.value) AS med, count(*) AS points FROM s a JOIN s b ON a.term = b.term AND b.date BETWEEN CAST(a.date - 89 AS DATE) AND a.date GROUP BY 1, 2, 3), k AS (SELECT j.term, j.date, j.value, j.med, j.points, median(abs(b.value - j.med)) AS mad FROM j JOIN s b ON b.term = j.term AND b.date BETWEEN CAST(j.date - 89 AS DATE) AND j.date GROUP BY 1, 2, 3, 4, 5) SELECT k.term AS term, k.date AS date, k.value AS value, CAST(points AS INTEGER) AS points, med AS median, mad, round((k.value - med) / nullif(1.4826 * mad, 0), 5) AS z, round(CAST(k.value AS DOUBLE) / nullif(o.value, 0) - 1, 6) AS growth FROM k LEFT JOIN s o ON o.term = k.term AND o.date = CAST(k.date - 28 AS DATE)")
def robust_trend(spark, sf):
    return M.robust_trend(_series(spark, sf)).select("term", "date", "value", "points", "median", "mad", r("z", 5), r("growth"))


@query()
def trend_ewma(spark, sf):
    return M.ewma(_series(spark, sf)).select("term", "date", "value", r("ewma", 4))


@query(f"WITH {SERIES}, m AS (SELECT term, median(value) AS med FROM s GROUP BY term), f AS (SELECT s.term, date FROM s JOIN m ON m.term = s.term WHERE value > med), g AS (SELECT term, date, date - CAST(row_number() OVER (PARTITION BY term ORDER BY date) AS INTEGER) AS k FROM f) SELECT term, min(date) AS first_day, max(date) AS last_day, count(*) AS days FROM g GROUP BY term, k HAVING count(*) >= 3")
def persistence(spark, sf):
    s = _series(spark, sf)
    m = s.groupBy("term").agg(F.median("value").alias("med"))
    return M.persistence(s.join(m, "term").select("term", "date", (F.col("value") > F.col("med")).alias("up")))


def _answers(spark, sf):
    c = t(spark, sf, "conversations").filter("role = 'assistant'")
    engine = F.concat(F.lit("e"), (F.col("conv_id") % 2).cast("string"))
    cited = F.when(F.col("turn") % 2 == 1, F.array(F.lit("ours.example"))).otherwise(F.array(F.lit("other.example")))
    return c.select(engine.alias("engine"), F.lit("api").alias("grounding"), (F.col("conv_id") % 5).alias("prompt_id"), F.col("conv_id").alias("repeat"), F.col("text").alias("answer"), cited.alias("cited"), F.lit(None).cast("string").alias("error"))


@query("WITH a AS (SELECT 'e' || CAST(conv_id % 2 AS VARCHAR) AS engine, conv_id % 5 AS prompt_id, conv_id, lower(text) AS x, text, turn % 2 = 1 AS cited, position('the' IN lower(text)) AS pl FROM conversations WHERE role = 'assistant'), r AS (SELECT engine, min(r) AS repeats FROM (SELECT engine, prompt_id, count(DISTINCT conv_id) AS r FROM a GROUP BY 1, 2) GROUP BY engine), b AS (SELECT engine, count(*) AS answers, avg(CASE WHEN cited THEN 1.0 ELSE 0.0 END) AS cr, avg(CASE WHEN pl > 0 THEN 1.0 ELSE 0.0 END) AS mr, CAST(count(*) FILTER (WHERE pl > 0) AS DOUBLE) / (count(*) FILTER (WHERE pl > 0) + count(*) FILTER (WHERE contains(x, 'with')) + count(*) FILTER (WHERE contains(x, 'nicht'))) AS sov, CAST(count(*) FILTER (WHERE cited AND pl = 0) AS DOUBLE) / nullif(count(*) FILTER (WHERE cited), 0) AS gm, count(*) FILTER (WHERE pl > 0 AND floor((pl - 1) * 3.0 / greatest(length(text), 1)) = 0) AS t1, count(*) FILTER (WHERE pl > 0 AND floor((pl - 1) * 3.0 / greatest(length(text), 1)) = 1) AS t2, count(*) FILTER (WHERE pl > 0 AND floor((pl - 1) * 3.0 / greatest(length(text), 1)) >= 2) AS t3 FROM a GROUP BY engine) SELECT b.engine AS engine, 'api' AS grounding, answers, round(cr, 6) AS citation_rate, round(mr, 6) AS mention_rate, round(sov, 6) AS share_of_voice, round(gm, 6) AS ghost_mention_rate, t1 AS first_third, t2 AS middle, t3 AS last_third, repeats, repeats < 3 AS refused FROM b JOIN r ON r.engine = b.engine")
def answer_scores(spark, sf):
    out = M.answer_scores(_answers(spark, sf), "the", "ours.example", ["with", "nicht"])
    return out.select("engine", "grounding", "answers", r("citation_rate"), r("mention_rate"), r("share_of_voice"), r("ghost_mention_rate"), "first_third", "middle", "last_third", "repeats", "refused")


@query("WITH h AS (SELECT event_type AS bot, '/' || CAST(user_id AS VARCHAR) AS url, CASE WHEN event_id % 10 = 0 THEN 404 ELSE 200 END AS status, ts FROM events) SELECT bot, count(*) AS fetches, count(DISTINCT url) AS unique_urls, round(avg(CASE WHEN status = 404 THEN 1.0 ELSE 0.0 END), 6) AS share_404, min(ts) AS first_seen, max(ts) AS last_seen FROM h GROUP BY bot")
def bot_stats(spark, sf):
    e = t(spark, sf, "events")
    hits = e.select(F.col("event_type").alias("bot"), F.concat(F.lit("/"), F.col("user_id").cast("string")).alias("url"), F.when(F.col("event_id") % 10 == 0, 404).otherwise(200).alias("status"), "ts")
    return M.bot_stats(hits).select("bot", "fetches", "unique_urls", r("share_404"), "first_seen", "last_seen")


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def hourly_archive(spark, sf):
    return T.hourly(t(spark, sf, "events")).select("hour", "event_type", "n", r("total", 3))


@query("WITH h AS (SELECT DISTINCT date_trunc('hour', ts) AS hour FROM events), b AS (SELECT min(hour) AS a, max(hour) AS z FROM h), e AS (SELECT unnest(generate_series(a, z, INTERVAL 1 HOUR)) AS hour FROM b) SELECT hour FROM e WHERE hour NOT IN (SELECT hour FROM h)")
def hour_gaps(spark, sf):
    return T.hour_gaps(T.hourly(t(spark, sf, "events")))


@query("SELECT start, start + INTERVAL 7 DAY AS \"end\", event_type, count(*) AS n FROM (SELECT event_type, date_trunc('day', ts) - k * INTERVAL 1 DAY AS start FROM events, (SELECT unnest(range(7)) AS k)) GROUP BY start, event_type")
def sliding_windows(spark, sf):
    return T.sliding(t(spark, sf, "events"))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS new FROM events), g AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM g GROUP BY user_id, k")
def event_sessions(spark, sf):
    return T.sessions(t(spark, sf, "events"))


@query("WITH l AS (SELECT 'lens' || CAST(conv_id % 4 AS VARCHAR) AS lens, CAST(length(text) % 60 + 5 AS DOUBLE) AS minutes, turn % 3 = 0 AS rep FROM conversations), b AS (SELECT lens, quantile_cont(minutes, 0.8) AS p, avg(CASE WHEN rep THEN 1.0 ELSE 0.0 END) AS rw FROM l GROUP BY lens), c AS (SELECT lens, 10.0 * 60 / (p * (1 + rw)) AS c FROM b) SELECT round(min(c), 6) AS capacity, CAST(floor(min(c)) AS BIGINT) AS publish_cap_per_week, (list(lens ORDER BY c))[1] AS narrowest FROM c")
def review_capacity(spark, sf):
    c = t(spark, sf, "conversations")
    log = c.select(F.concat(F.lit("lens"), (F.col("conv_id") % 4).cast("string")).alias("lens"), (F.length("text") % 60 + 5).cast("double").alias("minutes"), (F.col("turn") % 3 == 0).alias("repeat"))
    hours = log.select("lens").distinct().withColumn("hours", F.lit(10.0))
    return M.review_capacity(log, hours).select(r("capacity"), "publish_cap_per_week", "narrowest")


@query("WITH o AS (SELECT 'R-' || CAST(doc_id % 9 AS VARCHAR) AS rule_id, quality = 0 AS fired, toxic = 1 AS ov FROM labels) SELECT rule_id, count(*) FILTER (WHERE fired) AS fired, count(*) FILTER (WHERE fired AND ov) AS overridden, count(*) AS checked, round(CAST(count(*) FILTER (WHERE fired AND ov) AS DOUBLE) / nullif(count(*) FILTER (WHERE fired), 0), 6) AS override_rate, count(*) FILTER (WHERE fired) = 0 AS dead FROM o GROUP BY rule_id")
def rule_statistics(spark, sf):
    rows = t(spark, sf, "labels").select(F.concat(F.lit("R-"), (F.col("doc_id") % 9).cast("string")).alias("rule_id"), (F.col("quality") == 0).alias("fired"), (F.col("toxic") == 1).alias("overridden"))
    return M.rule_stats(rows).select("rule_id", "fired", "overridden", "checked", r("override_rate"), "dead")


@query("WITH v AS (SELECT o_custkey % 200 AS draft, o_orderkey % 3 AS locus, 'l' || CAST(o_orderkey % 4 AS VARCHAR) AS lens, max(o_orderstatus) AS verdict FROM orders GROUP BY 1, 2, 3) SELECT a.draft AS draft, a.locus AS locus, a.lens AS lens_a, a.verdict AS verdict_a, b.lens AS lens_b, b.verdict AS verdict_b FROM v a JOIN v b ON a.draft = b.draft AND a.locus = b.locus AND a.lens < b.lens AND a.verdict <> b.verdict")
def review_disagreements(spark, sf):
    o = t(spark, sf, "orders")
    v = o.groupBy((F.col("o_custkey") % 200).alias("draft"), (F.col("o_orderkey") % 3).alias("locus"), F.concat(F.lit("l"), (F.col("o_orderkey") % 4).cast("string")).alias("lens")).agg(F.max("o_orderstatus").alias("verdict"))
    return M.disagreements(v)


@query("WITH l AS (SELECT o_orderkey AS draft, CAST(o_custkey % 4 AS INTEGER) AS step, 'G-' || CAST(o_custkey % 6 AS VARCHAR) AS rule_id, o_orderstatus = 'F' AS blocked FROM orders), f AS (SELECT draft, (list(rule_id ORDER BY step, rule_id))[1] AS rule_id FROM l WHERE blocked GROUP BY draft) SELECT rule_id, count(*) AS rejected, round(CAST(count(*) AS DOUBLE) / (SELECT count(DISTINCT draft) FROM l), 6) AS rejection_rate FROM f GROUP BY rule_id")
def rejection_causes(spark, sf):
    log = t(spark, sf, "orders").select(F.col("o_orderkey").alias("draft"), (F.col("o_custkey") % 4).cast("int").alias("step"), F.concat(F.lit("G-"), (F.col("o_custkey") % 6).cast("string")).alias("rule_id"), (F.col("o_orderstatus") == "F").alias("blocked"))
    return M.rejection_causes(log).select("rule_id", "rejected", r("rejection_rate"))


@query("WITH a AS (SELECT l_partkey AS topic, min(l_linenumber) AS p, count(*) AS n FROM lineitem WHERE l_suppkey % 5 <> 0 GROUP BY 1), b AS (SELECT l_partkey AS topic, min(l_linenumber) AS p FROM lineitem WHERE l_suppkey % 5 = 0 GROUP BY 1) SELECT a.topic AS topic, a.p AS best, n AS rivals, b.p AS own, CASE WHEN b.p IS NULL THEN 'missing' ELSE 'weaker' END AS gap FROM a LEFT JOIN b ON a.topic = b.topic WHERE b.p IS NULL OR b.p > a.p")
def content_gap(spark, sf):
    li = t(spark, sf, "lineitem").select(F.col("l_partkey").alias("topic"), F.col("l_linenumber").alias("position"), (F.col("l_suppkey") % 5 == 0).alias("own"))
    return M.content_gap(li.filter("not own"), li.filter("own"))


@query("WITH a AS (SELECT c_custkey AS url, c_nationkey AS m FROM customer WHERE c_custkey % 5 <> 0), b AS (SELECT c_custkey AS url, CASE WHEN c_custkey % 7 = 0 THEN 99 ELSE c_nationkey END AS m FROM customer WHERE c_custkey % 3 <> 0) SELECT coalesce(a.url, b.url) AS url, CASE WHEN b.url IS NULL THEN 'added' WHEN a.url IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.url = b.url WHERE b.url IS NULL OR a.url IS NULL OR a.m <> b.m")
def sitemap_diff(spark, sf):
    c = t(spark, sf, "customer")
    a = c.filter("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("url"), F.col("c_nationkey").alias("lastmod"))
    b = c.filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("url"), F.when(F.col("c_custkey") % 7 == 0, 99).otherwise(F.col("c_nationkey")).alias("lastmod"))
    return M.sitemap_diff(a, b).select("url", "change")


# --- further operators ----------------------------------------------------


@query("WITH d AS (SELECT l_suppkey AS query, CAST(date_trunc('year', l_shipdate) AS DATE) AS date, list_sort(list_distinct(list(l_partkey))) AS urls FROM lineitem GROUP BY 1, 2), p AS (SELECT query, date, urls[1:10] AS urls FROM d), w AS (SELECT *, lag(urls) OVER (PARTITION BY query ORDER BY date) AS before FROM p), c AS (SELECT query, CAST(len(list_filter(urls, lambda u: NOT list_contains(before, u))) AS DOUBLE) / len(urls) AS t FROM w WHERE before IS NOT NULL) SELECT query, round(avg(t), 6) AS turnover, count(*) AS snapshots FROM c GROUP BY query")
def serp_turnover(spark, sf):
    li = t(spark, sf, "lineitem")
    snaps = li.groupBy(F.col("l_suppkey").alias("query"), F.date_trunc("year", "l_shipdate").cast("date").alias("date")).agg(F.sort_array(F.collect_set("l_partkey")).alias("urls"))
    return M.turnover(snaps).select("query", r("turnover"), "snapshots")


@query("SELECT p_brand AS page, median(date_diff('day', CAST(l_shipdate AS DATE), DATE '2002-01-01')) AS source_age_median FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand")
def source_age(spark, sf):
    c = t(spark, sf, "lineitem").join(t(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return M.source_age(c.select(F.col("p_brand").alias("page"), F.lit(dt.date(2002, 1, 1)).alias("checked"), F.to_date("l_shipdate").alias("published")))


@query("WITH f AS (SELECT l_orderkey AS query, l_linenumber % 3 AS k FROM lineitem), i AS (SELECT query, CASE k WHEN 0 THEN 'informational' WHEN 1 THEN 'transactional' ELSE 'commercial' END AS intent, count(*) AS n FROM f GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY n DESC, intent) AS rn, sum(n) OVER (PARTITION BY query) AS tot FROM i) SELECT query, intent, round(CAST(n AS DOUBLE) / tot, 6) AS confidence, CAST(n AS DOUBLE) / tot < 0.5 AS arbitrate FROM rk WHERE rn = 1")
def query_intent(spark, sf):
    li = t(spark, sf, "lineitem")
    feats = li.groupBy(F.col("l_orderkey").alias("query")).agg(F.collect_list((F.col("l_linenumber") % 3).cast("int")).alias("features"))
    rules = spark.createDataFrame([(0, "informational"), (1, "transactional"), (2, "commercial")], "feature int, intent string")
    return M.intent_of(feats, rules).select("query", "intent", r("confidence"), "arbitrate")


@query("WITH h AS (SELECT o_custkey AS doc_id, o_orderkey AS pos, CAST(1 + o_orderkey % 4 AS INTEGER) AS level FROM orders), b AS (SELECT *, lag(level) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM h) SELECT doc_id, pos, level, before FROM b WHERE level - before > 1")
def heading_skips(spark, sf):
    h = t(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), (1 + F.col("o_orderkey") % 4).cast("int").alias("level"))
    return C.heading_skips(h)


@query("WITH l AS (SELECT conv_id AS doc_id, turn AS pos, CASE length(text) % 3 WHEN 0 THEN 'item' WHEN 1 THEN 'prose' ELSE 'blank' END AS kind FROM conversations), s AS (SELECT doc_id, pos, kind, CASE WHEN kind = 'item' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY pos), 'blank') <> 'item' THEN 1 ELSE 0 END AS st, sum(CASE WHEN kind = 'prose' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM l), g AS (SELECT doc_id, island, sum(st) AS n FROM s GROUP BY 1, 2) SELECT doc_id, CAST(max(n) AS BIGINT) AS longest_run FROM g GROUP BY doc_id")
def list_runs(spark, sf):
    k = F.length("text") % 3
    return C.list_runs(t(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(k == 0, "item").when(k == 1, "prose").otherwise("blank").alias("kind")))


@query("WITH c AS (SELECT l_orderkey % 100 AS draft, CASE WHEN l_linenumber <= 4 THEN 'factual' ELSE 'opinion' END AS kind, CASE l_returnflag WHEN 'R' THEN NULL WHEN 'A' THEN 'primary' ELSE 'secondary' END AS tier, CASE WHEN l_suppkey % 50 = 0 THEN 404 WHEN l_suppkey % 51 = 0 THEN NULL ELSE 200 END AS http, l_quantity > 45 AS fp FROM lineitem) SELECT draft, round(CAST(count(*) FILTER (WHERE kind = 'factual' AND tier IS NOT NULL) AS DOUBLE) / nullif(count(*) FILTER (WHERE kind = 'factual'), 0), 6) AS sourced_share, round(CAST(count(*) FILTER (WHERE kind = 'factual' AND tier = 'primary') AS DOUBLE) / nullif(count(*) FILTER (WHERE kind = 'factual' AND tier IS NOT NULL), 0), 6) AS primary_share, count(*) FILTER (WHERE http IS NULL OR http NOT BETWEEN 200 AND 299) AS dead, count(*) FILTER (WHERE fp) AS first_party FROM c GROUP BY draft")
def claim_shares(spark, sf):
    s = F.col("l_suppkey")
    c = t(spark, sf, "lineitem").select((F.col("l_orderkey") % 100).alias("draft"), F.when(F.col("l_linenumber") <= 4, "factual").otherwise("opinion").alias("kind"), F.when(F.col("l_returnflag") == "R", None).when(F.col("l_returnflag") == "A", "primary").otherwise("secondary").alias("tier"), F.when(s % 50 == 0, 404).when(s % 51 == 0, None).otherwise(200).alias("http_status"), (F.col("l_quantity") > 45).alias("first_party"))
    return C.claim_rules(c).select("draft", r("sourced_share"), r("primary_share"), "dead", "first_party")


@query("SELECT p_type AS key, count(DISTINCT p_size) AS values, count(DISTINCT p_brand) AS files FROM part GROUP BY p_type HAVING count(DISTINCT p_size) > 1")
def threshold_homes(spark, sf):
    return C.threshold_homes(t(spark, sf, "part").select(F.col("p_type").alias("key"), F.col("p_size").alias("value"), F.col("p_brand").alias("file")))


@query("WITH e AS (SELECT p_brand AS s, regexp_replace(lower(trim(p_type)), '\\s+', ' ', 'g') AS norm, p_size > 45 AS forbidden FROM part) SELECT DISTINCT a.norm AS norm, a.s AS prescribed_by, b.s AS forbidden_by FROM e a JOIN e b ON a.norm = b.norm WHERE NOT a.forbidden AND b.forbidden")
def prescribed_forbidden(spark, sf):
    return C.prescribed_forbidden(t(spark, sf, "part").select(F.col("p_brand").alias("set"), F.col("p_type").alias("phrase"), (F.col("p_size") > 45).alias("forbidden")))


@query("SELECT o_custkey % 40 AS pillar_id, count(*) AS clusters FROM orders GROUP BY 1 HAVING count(*) > 1")
def pillar_groups(spark, sf):
    return G.pillar_groups(t(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("pillar_id"), F.col("o_orderkey").alias("cluster_id"))).drop("cluster_ids")


@query("WITH x AS (SELECT CAST(l_shipdate AS DATE) AS data_date, l_linenumber AS v FROM lineitem WHERE l_linestatus = 'O'), e AS (SELECT data_date, max(v) AS epoch_version FROM x GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS data_date, min(l_linenumber) + 3 AS v FROM lineitem WHERE l_suppkey % 2 = 0 GROUP BY 1) SELECT e.data_date AS data_date, CAST(v AS INTEGER) AS _before, CAST(epoch_version AS INTEGER) AS epoch_version FROM e JOIN b ON e.data_date = b.data_date WHERE epoch_version > v")
def raised_epochs(spark, sf):
    li = t(spark, sf, "lineitem").withColumn("data_date", F.to_date("l_shipdate"))
    now_ = S.epochs(li.select("data_date", F.col("l_linenumber").alias("epoch_version"), F.col("l_linestatus").alias("agenda")), "O")
    before = li.filter("l_suppkey % 2 = 0").groupBy("data_date").agg((F.min("l_linenumber") + 3).cast("int").alias("epoch_version"))
    return sinks.raised_epochs(now_, before)


@query(f"SELECT CAST(l_shipdate AS DATE) AS date, l_returnflag AS query, 'p' || CAST(l_suppkey AS VARCHAR) AS page, 'd' AS device, 'c' AS country, CAST(sum(l_linenumber) AS BIGINT) AS clicks, CAST(sum(floor(l_quantity)) AS BIGINT) AS impressions, CAST(sum(l_linenumber * 3) AS DOUBLE) AS sum_position, round(CAST(sum(l_linenumber * 3) AS DOUBLE) / sum(floor(l_quantity)) + 1, 4) AS position FROM lineitem WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '{PRIOR[0]}' AND DATE '{NOW[1]}' GROUP BY 1, 2, 3")
def warehouse_rows(spark, sf):
    li = t(spark, sf, "lineitem")
    rows = li.select(F.to_date("l_shipdate").alias("data_date"), F.col("l_returnflag").alias("query"), F.concat(F.lit("p"), F.col("l_suppkey").cast("string")).alias("url"), F.lit("d").alias("device"), F.lit("c").alias("country"), F.col("l_linenumber").cast("long").alias("clicks"), F.floor("l_quantity").cast("long").alias("impressions"), (F.col("l_linenumber") * 3).cast("double").alias("sum_position"))
    return S.from_warehouse(rows, str(PRIOR[0]), str(NOW[1]))


@query("SELECT c_custkey AS id, CASE WHEN (c_acctbal - 4000) / nullif(4000, 0) >= 0.5 THEN 'confirmed' WHEN (c_acctbal - 4000) / nullif(4000, 0) <= -0.5 THEN 'reverted' WHEN c_custkey % 2 = 0 THEN 'inconclusive' ELSE 'extend_once' END AS outcome FROM customer")
def change_outcomes(spark, sf):
    return t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), M.change_outcome(F.lit(4000.0), F.col("c_acctbal"), F.lit(0.5), F.col("c_custkey") % 2 == 0).alias("outcome"))


@query("WITH s AS (SELECT p_partkey AS id, p_size / 10.0 AS z, p_size / 25.0 AS a, p_partkey % 5 AS s FROM part), c AS (SELECT id, 0.35 * least(greatest(z / 5.0, 0), 1) + 0.25 * least(greatest(a / 5.0, 0), 1) + 0.25 * (s / 4.0) + 0.15 * 0.5 AS sc FROM s) SELECT id, round(CAST(sc AS DOUBLE), 6) AS score, CASE WHEN sc + 1e-9 >= 0.65 THEN 'plan' WHEN sc + 1e-9 >= 0.45 THEN 'watchlist' ELSE 'discarded' END AS bucket FROM c")
def trend_scores(spark, sf):
    p = t(spark, sf, "part")
    score = M.trend_score(F.col("p_size") / 10.0, F.col("p_size") / 25.0, F.col("p_partkey") % 5, F.lit(0.5), 4)
    out = p.select(F.col("p_partkey").alias("id"), score.alias("sc"))
    return out.select("id", r("sc", 6, "score"), M.trend_bucket(F.col("sc")).alias("bucket"))


@query("WITH q AS (SELECT o_orderkey AS id, o_custkey % 50 AS k FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey AS id, o_custkey % 50 AS k FROM orders WHERE o_orderkey % 3 = 0) SELECT id, k FROM q UNION ALL SELECT id, k FROM n WHERE id NOT IN (SELECT id FROM q)")
def queue_append(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("k"))
    return M.queue_append(o.filter("id % 2 = 0"), o.filter("id % 3 = 0"), ["id"])


@query("WITH v AS (SELECT o_custkey AS file, o_orderkey AS line_no, o_orderpriority AS c FROM orders), s AS (SELECT DISTINCT o_custkey AS file, o_orderkey AS line_no, o_orderpriority AS c FROM orders WHERE o_orderkey % 6 = 0 AND o_orderpriority <> 'suppressions') SELECT v.file AS file, v.line_no AS line_no, v.c AS \"check\" FROM v LEFT JOIN s ON v.file = s.file AND v.line_no = s.line_no AND v.c = s.c WHERE s.file IS NULL")
def unsuppressed(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("check"))
    return C.suppressed(o, o.filter("line_no % 6 = 0"))[0]


@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings) SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.v, b.v), 4) AS similarity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) > 0.25")
def near_queries(spark, sf):
    e = t(spark, sf, "embeddings")
    e = e.select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"), F.col("embedding").alias("vector"))
    out = G.near_pairs(e, e, 0.25, once=True).filter("similarity > 0.25").select(F.col("donor").alias("a"), F.col("target").alias("b"), "similarity")
    return out.select("a", "b", r("similarity", 4))


@query(f"""WITH {OBS}, {WINS}, {PAIRS}, {CURVED},
st AS (SELECT count(*) AS n FROM (SELECT 1 FROM curved WHERE impressions >= 20 AND position BETWEEN 5 AND 20 AND ctr_expected > ctr LIMIT 50)), oc AS (SELECT count(*) AS n FROM curved WHERE impressions >= 50 AND position <= 10 AND ctr < 0.5 * ctr_expected), gp AS (SELECT count(*) AS n FROM (SELECT query FROM pairs GROUP BY query HAVING sum(impressions) >= 30 AND min(position) > 1.0)),
f AS (SELECT 'striking' AS detector, 'WARN' AS severity, n FROM st UNION ALL SELECT 'ctr_outliers', 'WARN', n FROM oc UNION ALL SELECT 'gaps', 'INFO', n FROM gp)
SELECT detector, severity, CAST(sum(n) AS BIGINT) AS n FROM f GROUP BY GROUPING SETS ((), (severity), (detector), (detector, severity)) HAVING sum(n) > 0""")
def report_summary(spark, sf):
    n = now(spark, sf)
    return O.summarise(O.findings({"striking": O.striking(n, LOWER), "ctr_outliers": O.ctr_outliers(n, LOWER), "gaps": O.gaps(n, LOWER)}))


from larkspur.plans import gate as _gate  # noqa: E402, F401  (registers its queries)
from larkspur.plans import lint as _lint  # noqa: E402, F401
from larkspur.plans import inputs as _inputs  # noqa: E402, F401
