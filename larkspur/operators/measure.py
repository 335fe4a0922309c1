"""Share of voice, calibration, cohorts, trends, answer engines, crawlers, capacity and rule statistics."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.scores import CTR_CLEAN, expected_ctr


def share_of_voice(serps: DataFrame) -> DataFrame:
    """CTR-weighted share of every domain within its locale, never across. ``locale``, ``query``, ``domain``, ``position``, ``weight``."""
    total = serps.dropDuplicates(["locale", "query"]).groupBy("locale").agg(F.sum("weight").alias("_total"))
    best = serps.groupBy("locale", "query", "domain").agg(F.min("position").alias("position"), F.max("weight").alias("weight"))
    own = best.groupBy("locale", "domain").agg(F.sum(expected_ctr(F.col("position").cast("double")) * F.col("weight")).alias("_won"), F.count(F.lit(1)).alias("queries"))
    return own.join(total, "locale").select("locale", "domain", "queries", (F.col("_won") / F.col("_total")).alias("sov"))


def calibrate_ctr(obs: DataFrame, least: int = 1000, full: int = 10_000) -> DataFrame:
    """Own rate by position bucket (1 to 10, 11-15, 16-20), blended with the prior by volume. Anonymised queries don't count; small buckets keep the prior."""
    p = F.bround("position").cast("int")
    bucket = F.when(p.between(1, 10), p).when(p.between(11, 15), 11).when(p.between(16, 20), 16)
    by = obs.filter("query <> ''").withColumn("bucket", bucket).filter("bucket is not null").groupBy("bucket").agg(F.sum("clicks").alias("clicks"), F.sum("impressions").alias("impressions")).filter(F.col("impressions") >= least)
    w = F.least(F.lit(1.0), F.col("impressions") / F.lit(float(full)))
    own = F.col("clicks") / F.col("impressions")
    middle = F.when(F.col("bucket") == 11, 13.0).when(F.col("bucket") == 16, 18.0).otherwise(F.col("bucket").cast("double"))
    return by.select("bucket", "clicks", "impressions", own.alias("ctr_own"), expected_ctr(middle, CTR_CLEAN).alias("ctr_prior"), w.alias("w")).withColumn("ctr_final", F.col("w") * F.col("ctr_own") + (1 - F.col("w")) * F.col("ctr_prior")).withColumn("provisional", F.col("w") < 0.3)


def cohort_weeks(obs: DataFrame, published: DataFrame, before: str) -> DataFrame:
    """Clicks for each page by cohort (month of publication; earlier ones: control) and week, change on the week before, and that less the control's. ``published``: page, first_date."""
    cohort = F.when(F.col("first_date") < F.lit(before).cast("date"), "control").otherwise(F.date_format("first_date", "yyyy-MM"))
    pages = published.withColumn("cohort", cohort)
    sizes = pages.groupBy("cohort").agg(F.count(F.lit(1)).alias("pages"))
    week = obs.join(pages.select("page", "cohort"), "page").groupBy("cohort", F.date_trunc("week", "date").cast("date").alias("week")).agg(F.sum("clicks").alias("clicks"))
    per = week.join(sizes, "cohort").withColumn("clicks_per_page", F.col("clicks") / F.col("pages"))
    w = Window.partitionBy("cohort").orderBy("week")
    moved = per.withColumn("_before", F.lag("clicks_per_page").over(w)).withColumn("delta", F.try_divide(F.col("clicks_per_page") - F.col("_before"), F.col("_before"))).drop("_before")
    control = moved.filter("cohort = 'control'").select("week", F.col("delta").alias("_control"))
    return moved.filter("cohort <> 'control'").join(control, "week", "left").withColumn("rel_delta", F.col("delta") - F.col("_control")).drop("_control")


def cohort_alerts(weeks: DataFrame) -> DataFrame:
    """Watch at -15 % and alarm at -30 % for two weeks in a row, alarm at -40 % once."""
    w = Window.partitionBy("cohort").orderBy("week")
    worst = F.greatest(F.col("rel_delta"), F.lag("rel_delta").over(w))
    two = F.when(F.lag("rel_delta").over(w).isNotNull(), worst)
    level = F.when((F.col("rel_delta") <= -0.40) | (two <= -0.30), "alarm").when(two <= -0.15, "watch")
    return weeks.withColumn("level", level).filter("level is not null")


def robust_trend(series: DataFrame, days: int = 90) -> DataFrame:
    """Median and MAD over the trailing days, robust z, growth on four weeks before. ``term``, ``date``, ``value``; a day is one row."""
    w = Window.partitionBy("term").orderBy(F.unix_date("date")).rangeBetween(-(days - 1), 0)
    middle = lambda a: (lambda s: (F.get(s, F.floor((F.size(s) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(s) / 2).cast("int"))) / 2.0)(F.array_sort(a))
    held = series.withColumn("_w", F.collect_list(F.col("value").cast("double")).over(w)).withColumn("median", middle(F.col("_w")))
    held = held.withColumn("mad", middle(F.transform("_w", lambda x: F.abs(x - F.col("median")))))
    old = series.select("term", F.date_add("date", 28).alias("date"), F.col("value").alias("_old"))
    return held.join(old, ["term", "date"], "left").select("term", "date", "value", F.size("_w").alias("points"), "median", "mad", F.try_divide(F.col("value") - F.col("median"), 1.4826 * F.col("mad")).alias("z"), (F.try_divide(F.col("value").cast("double"), F.col("_old").cast("double")) - 1).alias("growth"))


def ewma(series: DataFrame, alpha: float = 0.25) -> DataFrame:
    """Exponentially weighted mean of every term's values in date order: ``ewma``.

    A term's rows are sorted by Spark and handled batch by batch, so that a term of
    any length takes time in proportion and the last mean is all that is carried.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        term = mean = None
        for batch in batches:
            out = []
            for name, value in zip(batch.column("term").to_pylist(), batch.column("value").to_pylist(), strict=True):
                mean = value if name != term or mean is None else alpha * value + (1 - alpha) * mean
                term = name
                out.append(mean)
            yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("date"), batch.column("value"), pa.array(out, pa.float64())], ["term", "date", "value", "ewma"])

    rows = series.select("term", "date", F.col("value").cast("double").alias("value"))
    return rows.repartition("term").sortWithinPartitions("term", "date").mapInArrow(run, f"term {series.schema['term'].dataType.simpleString()}, date date, value double, ewma double")


def trend_score(z: Column, accel: Column, sources: Column, season: Column, max_sources: int) -> Column:
    """Weighted score; each part is cut to 0..1 (z and acceleration over 5)."""
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return 0.35 * unit(z / 5.0) + 0.25 * unit(accel / 5.0) + 0.25 * (sources / F.lit(float(max_sources))) + 0.15 * unit(season)


def breakout_score(sources: Column, velocity: Column, max_sources: int) -> Column:
    return F.when(sources >= 2, 0.6 * (sources / F.lit(float(max_sources))) + 0.4 * F.least(F.greatest(velocity, F.lit(0.0)), F.lit(1.0)))


#: What a comparison with a limit allows for rounding.
EPSILON = 1e-9


def trend_bucket(score: Column) -> Column:
    return F.when(score + EPSILON >= 0.65, "plan").when(score + EPSILON >= 0.45, "watchlist").otherwise("discarded")


def persistence(flags: DataFrame, least: int = 3) -> DataFrame:
    """Runs of consecutive days on which a term is up. ``term``, ``date``, ``up``."""
    w = Window.partitionBy("term").orderBy("date")
    up = flags.filter("up").withColumn("island", F.date_sub("date", F.row_number().over(w)))
    return up.groupBy("term", "island").agg(F.min("date").alias("first_day"), F.max("date").alias("last_day"), F.count(F.lit(1)).cast("long").alias("days")).filter(F.col("days") >= least).drop("island")


def turnover(snapshots: DataFrame, depth: int = 10) -> DataFrame:
    """Share of a result page that is new against the snapshot before, on average. ``query``, ``date``, ``urls``."""
    w = Window.partitionBy("query").orderBy("date")
    top = snapshots.withColumn("urls", F.slice("urls", 1, depth)).withColumn("before", F.lag("urls").over(w)).filter("before is not null")
    return top.groupBy("query").agg(F.avg(F.size(F.array_except("urls", "before")) / F.size("urls")).alias("turnover"), F.count(F.lit(1)).alias("snapshots"))


def content_gap(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """Topics that others cover and we don't, or worse. ``topic``, ``position`` in both."""
    mine = ours.groupBy("topic").agg(F.min("position").alias("own"))
    best = theirs.groupBy("topic").agg(F.min("position").alias("best"), F.count(F.lit(1)).alias("rivals"))
    return best.join(mine, "topic", "left").filter("own is null or own > best").withColumn("gap", F.when(F.col("own").isNull(), "missing").otherwise("weaker"))


def sitemap_diff(today: DataFrame, yesterday: DataFrame) -> DataFrame:
    """added, removed and changed urls. ``url``, ``lastmod``."""
    out = today.select("url", F.col("lastmod").alias("now")).join(yesterday.select("url", F.col("lastmod").alias("was")), "url", "full_outer")
    kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("was"), "changed")
    return out.withColumn("change", kind).filter("change is not null")


def answer_scores(answers: DataFrame, brand: str, domain: str, rivals: list[str], min_repeats: int = 3) -> DataFrame:
    """Citation, mention, voice, ghost mentions and place by engine and grounding, which are never pooled. Engines without enough repeats of a prompt aren't scored: ``refused``. ``engine``, ``grounding``, ``prompt_id``, ``repeat``, ``answer``, ``cited`` (array of domains), ``error``."""
    ok = answers.filter("error is null")
    text = F.lower("answer")
    at = F.instr(text, brand.lower())
    named, cited = at > 0, F.array_contains("cited", domain)
    others = sum((F.contains(text, F.lit(r.lower())).cast("int") for r in rivals), F.lit(0))
    third = F.floor((at - 1) * 3 / F.greatest(F.length("answer"), F.lit(1)))
    repeats = ok.groupBy("engine", "grounding", "prompt_id").agg(F.count_distinct("repeat").alias("r")).groupBy("engine", "grounding").agg(F.min("r").alias("repeats"))
    n = lambda c: F.sum(c.cast("int"))
    by = ok.groupBy("engine", "grounding").agg(F.count(F.lit(1)).alias("answers"), F.avg(cited.cast("double")).alias("citation_rate"), F.avg(named.cast("double")).alias("mention_rate"), F.try_divide(n(named).cast("double"), (n(named) + F.sum(others)).cast("double")).alias("share_of_voice"), F.try_divide(n(cited & ~named).cast("double"), n(cited).cast("double")).alias("ghost_mention_rate"), n(named & (third == 0)).alias("first_third"), n(named & (third == 1)).alias("middle"), n(named & (third >= 2)).alias("last_third"))
    return by.join(repeats, ["engine", "grounding"]).withColumn("refused", F.col("repeats") < min_repeats)


#: A combined access-log line.
LOG = "^(\\S+) \\S+ \\S+ \\[([^\\]]+)\\] \"(\\S+) (\\S+)[^\"]*\" (\\d{3}) (\\S+) \"[^\"]*\" \"([^\"]*)\""


def read_logs(lines: DataFrame, bots: list[str]) -> DataFrame:
    """Access-log lines of known crawlers: bot, url, status, ts. ``value``: the line."""
    part = lambda i: F.regexp_extract("value", LOG, i)
    agent = F.lower(part(7))
    bot = F.coalesce(*[F.when(F.contains(agent, F.lit(b.lower())), b) for b in bots], F.lit(None).cast("string"))
    return lines.select(bot.alias("bot"), part(4).alias("url"), part(5).try_cast("int").alias("status"), F.try_to_timestamp(part(2), F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts")).filter("bot is not null")


def bot_stats(hits: DataFrame) -> DataFrame:
    """Per bot: fetches, distinct urls, fetches by status, share of 404, first and last seen."""
    by = hits.groupBy("bot", "status").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    status = by.groupBy("bot").agg(F.sum("n").alias("fetches"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("by_status"), (F.sum(F.when(F.col("status") == 404, F.col("n")).otherwise(0)) / F.sum("n")).alias("share_404"), F.min("a").alias("first_seen"), F.max("b").alias("last_seen"))
    return status.join(hits.groupBy("bot").agg(F.count_distinct("url").alias("unique_urls")), "bot")


def source_age(claims: DataFrame) -> DataFrame:
    """Median age in days of the sources of each page. ``page``, ``checked``, ``published``."""
    return claims.filter("published is not null").groupBy("page").agg(F.median(F.datediff("checked", "published")).alias("source_age_median"))


def review_capacity(log: DataFrame, hours: DataFrame) -> DataFrame:
    """Drafts a week that the narrowest lens lets through: hours * 60 / (80th percentile of minutes * (1 + rework share)), floored. ``lens``, ``minutes``, ``repeat``; ``lens``, ``hours``."""
    by = log.groupBy("lens").agg(F.percentile("minutes", 0.8).alias("minutes_p80"), F.avg(F.col("repeat").cast("double")).alias("rework"))
    by = by.join(hours, "lens").withColumn("capacity", F.col("hours") * 60 / (F.col("minutes_p80") * (1 + F.col("rework"))))
    return by.agg(F.min("capacity").alias("capacity"), F.floor(F.min("capacity")).alias("publish_cap_per_week"), F.min_by("lens", "capacity").alias("narrowest"))


def rule_stats(outcomes: DataFrame) -> DataFrame:
    """Per rule: fired, overridden, override rate, whether it is dead. ``rule_id``, ``page``, ``fired``, ``overridden``."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    return outcomes.groupBy("rule_id").agg(n(F.col("fired")).alias("fired"), n(F.col("fired") & F.col("overridden")).alias("overridden"), F.count(F.lit(1)).alias("checked")).withColumn("override_rate", F.try_divide(F.col("overridden").cast("double"), F.col("fired").cast("double"))).withColumn("dead", F.col("fired") == 0)


def disagreements(verdicts: DataFrame) -> DataFrame:
    """Pairs of lenses that judge one place of a draft differently. A place has a handful of lenses, so its pairs are few. ``draft``, ``locus``, ``lens``, ``verdict``."""
    a = verdicts.select("draft", "locus", F.col("lens").alias("lens_a"), F.col("verdict").alias("verdict_a"))
    b = verdicts.select("draft", "locus", F.col("lens").alias("lens_b"), F.col("verdict").alias("verdict_b"))
    return a.join(b, ["draft", "locus"]).filter("lens_a < lens_b and verdict_a <> verdict_b")


def queue_append(queue: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The queue with the rows that it doesn't have yet: appending twice changes nothing."""
    return queue.unionByName(new.dropDuplicates(keys).join(queue.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def rejection_causes(log: DataFrame) -> DataFrame:
    """Drafts by the first rule that blocked them, and their share of all drafts. ``draft``, ``step``, ``rule_id``, ``blocked``."""
    first = log.filter("blocked").groupBy("draft").agg(F.min(F.struct("step", "rule_id")).alias("m"))
    n = log.agg(F.count_distinct("draft").alias("drafts"), F.lit(1).alias("k"))
    by = first.groupBy(F.col("m.rule_id").alias("rule_id")).agg(F.count(F.lit(1)).alias("rejected"), F.lit(1).alias("k"))
    return by.join(F.broadcast(n), "k").select("rule_id", "rejected", (F.col("rejected") / F.col("drafts")).alias("rejection_rate"))


def change_outcome(before: Column, after: Column, least: Column, extended: Column) -> Column:
    """confirmed, reverted or inconclusive; what is inconclusive is extended once."""
    move = F.try_divide(after - before, before)
    return F.when(move >= least, "confirmed").when(move <= -least, "reverted").when(extended, "inconclusive").otherwise("extend_once")


def intent_of(features: DataFrame, rules: DataFrame) -> DataFrame:
    """Intent of a query from features of its result page: the intent with most signals, its share as confidence, whether a person must decide. ``query``, ``features`` (array); ``feature``, ``intent``."""
    one = features.select("query", F.explode("features").alias("feature")).join(F.broadcast(rules), "feature")
    by = one.groupBy("query", "intent").agg(F.count(F.lit(1)).alias("n"))
    top = by.groupBy("query").agg(F.min(F.struct((-F.col("n")).alias("n"), "intent")).alias("m"), F.sum("n").alias("signals"))
    confidence = -F.col("m.n") / F.col("signals")
    return top.select("query", F.col("m.intent").alias("intent"), confidence.alias("confidence"), (confidence < 0.5).alias("arbitrate"))


def gap_types(pairs: DataFrame, top: int = 10, outside: int = 100, stale_days: int = 180) -> DataFrame:
    """The seven ways in which others are ahead on a topic, one row for each: ``topic``, ``gap``.

    ``topic``, ``their_position``, ``our_position``, ``their_entities``, ``our_entities``, ``their_depth``, ``our_depth`` (blocks of
    content), ``wanted_formats``, ``our_formats``, ``their_intents``, ``our_intents``, ``their_updated``, ``our_updated`` (dates), ``their_cited``, ``our_cited``.
    """
    have = F.col("our_position").isNotNull()
    lacks = lambda a, b: F.size(F.array_except(a, b)) > 0
    tests = {
        "keyword": (F.col("their_position") <= top) & (~have | (F.col("our_position") > outside)),
        "entity": have & lacks("their_entities", "our_entities"),
        "depth": have & (F.col("their_depth") > F.col("our_depth")),
        "format": lacks("wanted_formats", "our_formats"),
        "intent": have & lacks("their_intents", "our_intents"),
        "freshness": have & (F.datediff("their_updated", "our_updated") > stale_days),
        "citation": F.col("their_cited") & ~F.col("our_cited"),
    }
    found = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in tests.items()]), lambda x: x.isNotNull())
    return pairs.select("topic", F.explode(found).alias("gap"))


def refresh_queue(pages: DataFrame) -> DataFrame:
    """Pages to refresh: ``page``, ``score`` (traffic potential times business value times effort efficiency), ``bucket``, ``trigger``, ``needs_approval``.

    ``page``, ``traffic``, ``value``, ``efficiency`` (0..1), ``position``, ``decline`` (relative change over three months), ``overtaken``, ``volume_high``,
    ``competing``, ``age_months``, ``citation_lost``.
    """
    down = F.col("decline") < 0
    bucket = F.when(F.col("competing"), "consolidation").when(F.col("overtaken"), "competitive_threat").when(F.col("volume_high") & (F.col("position") > 10), "foundation_rebuild").when((F.col("position") <= 10) & down, "quick_win")
    by_age = F.when(F.col("age_months") >= 24, "rewrite_or_delete").when(F.col("age_months") >= 18, "full_refresh").when(F.col("age_months") >= 12, "gap_analysis").when(F.col("age_months") >= 6, "numbers")
    trigger = F.when(F.col("citation_lost"), "freshness").when(F.col("overtaken"), "competitive").when(down, "urgent").otherwise(by_age)
    out = pages.select("page", F.round(F.col("traffic") * F.col("value") * F.col("efficiency"), 6).alias("score"), bucket.alias("bucket"), trigger.alias("trigger"))
    return out.filter("bucket is not null or trigger is not null").withColumn("needs_approval", F.coalesce(F.col("bucket").isin("consolidation", "foundation_rebuild"), F.lit(False)))


def process_indicators(drafts: DataFrame, changes: DataFrame, rules: DataFrame) -> DataFrame:
    """One row: human minutes for each published draft (its own, and with those of the rejected), rework, rule churn, days to a merged change, share of confirmed changes.

    ``drafts``: ``draft``, ``minutes``, ``published``, ``reworks``. ``changes``: ``reached``, ``merged`` (dates), ``verdict``. ``rules``: ``rule_id``, ``change`` (null, added, modified, deleted).
    """
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    one = F.lit(1).alias("_k")
    a = drafts.agg(F.try_divide(F.sum(F.when(F.col("published"), F.col("minutes"))).cast("double"), n(F.col("published"))).alias("htpi_published"), F.try_divide(F.sum("minutes").cast("double"), n(F.col("published"))).alias("htpi_true"), F.avg((F.col("reworks") > 0).cast("double")).alias("rework_rate"), F.avg(F.col("reworks").cast("double")).alias("rework_iterations"), one)
    b = changes.agg(F.median(F.datediff("merged", "reached")).alias("days_to_merge"), F.try_divide(n(F.col("verdict") == "confirmed").cast("double"), n(F.col("verdict").isin("confirmed", "reverted", "inconclusive"))).alias("confirmation_rate"), one)
    c = rules.agg(F.try_divide(F.count("change").cast("double"), F.count(F.lit(1))).alias("churn"), one)
    return a.join(b, "_k").join(c, "_k").drop("_k")


def conflicting_rules(outcomes: DataFrame, least: int = 3) -> DataFrame:
    """Pairs of rules of which one is overridden wherever the other fires. ``rule_id``, ``page``, ``fired``, ``overridden``. A page fires a handful of rules."""
    hits = outcomes.filter("fired").select("page", "rule_id", "overridden").distinct()
    a, b = (hits.select("page", F.col("rule_id").alias(f"rule_{x}"), F.col("overridden").alias(f"_{x}")) for x in "ab")
    both = a.join(b, "page").filter("rule_a < rule_b").groupBy("rule_a", "rule_b").agg(F.count(F.lit(1)).alias("pages"), F.sum((F.col("_a") != F.col("_b")).cast("int")).alias("opposed"))
    return both.filter((F.col("pages") >= least) & (F.col("opposed") == F.col("pages")))


def hidden_content(pages: DataFrame, share: float = 0.30) -> DataFrame:
    """Pages whose markup has few of the words that the rendered page shows. ``url``, ``raw_words``, ``rendered_words``."""
    return pages.filter(F.col("raw_words") < share * F.col("rendered_words")).select("url", "raw_words", "rendered_words")


def generated_timestamps(pages: DataFrame, run_date: str, share: float = 0.50) -> DataFrame:
    """One row: the share of rows that were changed on the day of the run, and whether their dates tell nothing (``use_hash``). ``updated_at``."""
    return pages.agg(F.round(F.avg((F.to_date("updated_at") == F.lit(run_date).cast("date")).cast("double")), 6).alias("today_share")).withColumn("use_hash", F.col("today_share") > share)
