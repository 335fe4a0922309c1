"""The gate for drafts: every rule gives a row (draft, rule_id, severity, status, value, limit).

A status is one of ``pass``, ``fail``, ``requires_agent``, ``requires_input`` and
``not_applicable``; only ``pass`` passes. Rules over the text work on the row of
a draft and need no shuffle; rules over claims are one aggregation by draft.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.text import INVISIBLE, TOOL_MARKS, TRACKING, isbn_valid, let, mixed_script, sentences, tokens
from larkspur.thresholds import Thresholds

#: The rule book's limits for drafts.
LIMITS = {
    "wrt11.sourced_share_min": 0.85,
    "wrt11.sourced_share_min_ymyl": 1.00,
    "wrt12.primary_source_ratio_min": 0.50,
    "wrt13.link_liveness_min": 1.00,
    "wrt14.date_divergence_days_max": 90,
    "wrt15.volatile_source_age_days_max": 30,
    "wrt20.ocd_min": 2.0,
    "wrt21.entity_gain_warn": 0.15,
    "wrt21.entity_gain_block": 0.08,
    "wrt22.entity_coverage_min": 0.70,
    "wrt22.entity_coverage_max": 0.90,
    "wrt23.ngram_n": 8,
    "wrt23.ngram_overlap_max": 0.03,
    "wrt24.cannibalization_cos_max": 0.85,
    "wrt25.site_drift_max": 0.45,
    "wrt26.words_per_claim_max": 250,
    "wrt30.time_to_answer_words_max": 60,
    "wrt31.passage_self_sufficiency_min": 0.90,
    "wrt33.first_third_core_coverage_min": 0.60,
    "wrt34.long_document_words": 1200,
    "wrt34.structural_variety_min": 2,
    "wrt40.sentence_length_sd_min": 6.0,
    "wrt41.mid_length_share_max": 0.65,
    "wrt42.uniform_paragraph_share_max": 0.60,
    "wrt43.repeated_opener_share_max": 0.12,
    "wrt44.ttr_min": 0.38,
    "wrt44.ttr_window_words": 500,
    "wrt45.consecutive_lists_max": 2,
    "wrt46.rule_of_three_share_max": 0.50,
    "lang.density_min_words": 300,
}
#: Fields that a brief must have, kinds of unique value and of artifacts, keys that demand a length.
BRIEF_FIELDS = ("topic_id", "locale", "surface_type", "target", "answer_intent", "audience", "unique_value_source", "entity_map", "mandated_proof_sources", "cannibalization_check", "forbidden", "reviewers")
VALUE_KINDS = ("first_party_data", "own_measurement", "interview", "own_calculation", "primary_source_analysis", "original_media", "proprietary_tool")
ARTIFACT_KINDS = ("export", "measurement", "interview", "survey", "calculation", "primary_reading", "original_media")
LENGTH_KEYS = ("min_words", "max_words", "target_words", "word_count", "word_count_target", "length_target", "min_length")
#: Ways to demand a number of words.
LENGTH_DEMANDS = (
    r"\b\d{3,6}\s*[-–—+]?\s*(?:\d{3,6})?\s*(?:words?|word-count)\b",
    r"\b(?:min(?:imum)?|at least|no fewer than)\b[^.\n]{0,30}\bwords?\b",
    r"\b(?:optimal|ideal|target|sweet spot)\b[^.\n]{0,30}\b(?:length|words?)\b",
    r"\bword count\b",
    r"\b\d{3,6}\s*[-–—+]?\s*(?:\d{3,6})?\s*(?:слів|слов|знаків|символів)\b",
    r"\b(?:мінімум|минимум|не менше|не менее)\b[^.\n]{0,30}\b(?:слів|слов|знаків)\b",
)
#: Rules that stop a publication, and families of models.
BLOCKING = ("WRT-01", "WRT-02", "WRT-03", "WRT-04", "WRT-05", "WRT-10", "WRT-11", "WRT-13", "WRT-15", "WRT-16", "WRT-17", "WRT-20", "WRT-21", "WRT-23", "WRT-24", "WRT-32", "WRT-50", "WRT-51", "WRT-52", "WRT-53", "WRT-60", "WRT-61", "WRT-62")
FAMILIES = ("claude", "gpt", "gemini", "llama", "mistral", "qwen", "deepseek", "grok", "command")

EPSILON = 1e-9
_ITEM = r"^\s*(?:[-*+]|\d+[.)])\s+.*$"


def limits(local: Mapping | None = None) -> Thresholds:
    return Thresholds(local, LIMITS)


def rule(rule_id: str, severity: str | Column, status: Column | str, value: Column | None = None, limit: Column | float | None = None) -> Column:
    text = lambda x: x if isinstance(x, Column) else F.lit(x)
    number = lambda x: F.lit(None).cast("double") if x is None else (x if isinstance(x, Column) else F.lit(x)).cast("double")
    return F.struct(F.lit(rule_id).alias("rule_id"), text(severity).alias("severity"), text(status).alias("status"), number(value).alias("value"), number(limit).alias("limit"))


def judged(rows: DataFrame, *rules: Column) -> DataFrame:
    """One row for each draft and rule."""
    return rows.select("draft", F.explode(F.array(*rules)).alias("_r")).select("draft", "_r.*")


def failing(bad: Column, otherwise: str = "pass") -> Column:
    return F.when(bad, "fail").otherwise(otherwise)


def at_least(value: Column, least: Column | float, missing: str = "requires_input") -> Column:
    return F.when(value.isNull(), missing).otherwise(failing(value + EPSILON < least))


def at_most(value: Column, most: Column | float, missing: str = "requires_input") -> Column:
    return F.when(value.isNull(), missing).otherwise(failing(value - EPSILON > most))


# Parsing. Markup comes out first, so that only prose is measured.


def is_html(raw: Column) -> Column:
    return raw.rlike("(?i)<(p|div|article|h[1-6])\\b")


def prose(raw: Column) -> Column:
    """Without code fences, table rows, quoted blocks and, in HTML, tags; blanks normalised."""
    out = F.regexp_replace(raw, "(?s)```.*?```", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "(?m)^\\s*\\|.*\\|\\s*$", ""), "(?m)^\\s*>.*$", "")
    out = F.when(is_html(raw), F.regexp_replace(out, "<[^>]+>", " ")).otherwise(out)
    out = F.regexp_replace(F.regexp_replace(F.regexp_replace(out, " ", " "), "​", ""), "[ \\t]+", " ")
    return F.btrim(F.regexp_replace(out, "\\n{3,}", "\n\n"), F.lit(" \t\n\r\x0b\x0c"))


def lines(text: Column) -> Column:
    return F.split(text, "\\r?\\n")


def without_items(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(_ITEM)), "\n")


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\\n\\s*\\n"), lambda p: F.btrim(p) != "")


def line_kinds(raw: Column) -> Column:
    """One letter for each line: i an item, p prose, b blank."""
    return F.array_join(F.transform(lines(raw), lambda x: F.when(x.rlike(_ITEM), "i").when(F.btrim(x) == "", "b").otherwise("p")), "")


def heading_levels(raw: Column) -> Column:
    return F.transform(F.regexp_extract_all(raw, F.lit("(?m)^(#{1,6})\\s+.*?\\s*$"), F.lit(1)), lambda h: F.length(h))


def section_openers(raw: Column) -> Column:
    """The first sentence of every section with a heading."""
    bodies = F.slice(F.split(raw, "(?m)^#{1,6}\\s+.*$"), 2, 1_000_000)
    return F.filter(F.transform(bodies, lambda b: F.element_at(F.concat(sentences(F.btrim(b, F.lit(" \t\n\r"))), F.array(F.lit(""))), 1)), lambda s: s != "")


def parsed(drafts: DataFrame) -> DataFrame:
    """``draft``, ``raw`` to the units that the rules read, each computed once for a row."""
    held = drafts.select("draft", F.coalesce("raw", F.lit("")).alias("raw"))
    text = let(prose(F.col("raw")), lambda t: F.struct(t.alias("text"), tokens(t).alias("words"), paragraphs(t).alias("paragraphs"), sentences(without_items(t)).alias("sentences")))
    return held.select("draft", "raw", text.alias("_t"), line_kinds(F.col("raw")).alias("kinds"), heading_levels(F.col("raw")).alias("headings")).select("draft", "raw", "_t.*", "kinds", "headings")


# Groups of rules.


def brief_rules(briefs: DataFrame, problems: DataFrame | None = None) -> DataFrame:
    """WRT-01 to 05. ``draft``, ``fields``: the brief flattened to dotted paths and texts. ``problems``: ``artifact_id``, ``problems`` of checked artifacts."""
    paths = F.map_keys("fields")
    filled = F.map_filter("fields", lambda k, v: F.btrim(F.coalesce(v, F.lit(""))) != "")
    missing = F.size(F.filter(F.array(*[F.lit(f) for f in BRIEF_FIELDS]), lambda f: ~F.exists(F.map_keys(filled), lambda k: (k == f) | k.startswith(F.concat(f, F.lit("."))))))
    field = lambda name: F.try_element_at(F.col("fields"), F.lit(name))
    value = F.coalesce(field("unique_value_source.kind").isin(*VALUE_KINDS), F.lit(False)) & (F.btrim(F.coalesce(field("unique_value_source.description"), F.lit(""))) != "")
    demand = "(?iu)" + "|".join(f"(?:{p})" for p in LENGTH_DEMANDS)
    texts = F.map_filter("fields", lambda k, v: ~k.startswith("volume_expectation"))
    demands = F.size(F.filter(paths, lambda k: k.isin(*LENGTH_KEYS))) + F.size(F.filter(F.map_values(texts), lambda v: F.coalesce(v.rlike(demand), F.lit(False))))
    held = briefs.select("draft", missing.alias("_missing"), value.alias("_value"), demands.alias("_demands"), field("unique_value_source.artifact_id").alias("artifact_id"))
    status = F.when(F.col("artifact_id").isNull(), "fail").otherwise("requires_input")
    if problems is not None:
        held = held.join(problems.select("artifact_id", F.col("problems").alias("_problems")), "artifact_id", "left")
        status = F.when(F.col("artifact_id").isNull(), "fail").otherwise(failing(F.coalesce(F.col("_problems"), F.lit(1)) > 0))
    return judged(
        held,
        rule("WRT-01", "BLOCK", failing(F.col("_missing") > 0), len(BRIEF_FIELDS) - F.col("_missing"), len(BRIEF_FIELDS)),
        rule("WRT-02", "BLOCK", failing(~F.col("_value"))),
        rule("WRT-03", "BLOCK", status),
        rule("WRT-04", "BLOCK", failing(F.col("_demands") > 0), F.col("_demands"), 0),
        rule("WRT-05", "BLOCK", "requires_agent"),
    )


def artifact_problems(manifests: DataFrame) -> DataFrame:
    """``artifact_id`` and the number of ``problems`` of each manifest: its kind, its author (an agent can't originate material), its method, its files and their hashes.

    ``artifact_id``, ``kind``, ``created_by``, ``method``, ``sha256`` and ``found`` (the stated and the actual hash of every file, null for a missing one).
    """
    author = F.lower(F.btrim(F.coalesce("created_by", F.lit(""))))
    files = F.coalesce(F.size("found"), F.lit(0))
    wrong = F.size(F.filter(F.arrays_zip(F.coalesce("sha256", F.array().cast("array<string>")).alias("s"), "found"), lambda x: x["found"].isNull() | (x["s"].isNotNull() & (F.lower(F.btrim(x["s"])) != x["found"]))))
    flags = [~F.coalesce(F.col("kind").isin(*ARTIFACT_KINDS), F.lit(False)), (author == "") | author.startswith("agent"), F.btrim(F.coalesce("method", F.lit(""))) == "", files <= 0]
    return manifests.select("artifact_id", (sum((f.cast("int") for f in flags), F.lit(0)) + F.when(files > 0, wrong).otherwise(0)).alias("problems"))


def claim_rules(briefs: DataFrame, claims: DataFrame, t: Thresholds) -> DataFrame:
    """WRT-10 to 16, 20 and 26.

    ``briefs``: ``draft``, ``ymyl``, ``byline``, ``created`` (dates), ``words``, ``cited`` and ``mandated`` (claim ids).
    ``claims``: ``draft``, ``id``, ``kind``, ``source_url``, ``source_tier``, ``http_status``, ``published`` (date), ``volatile``, ``provenance``, ``artifact_id``.
    """
    factual = F.col("kind").isin("fact", "figure", "quote", "definition")
    sourced = F.btrim(F.coalesce("source_url", F.lit(""))) != ""
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int"))
    most = t.get("wrt15.volatile_source_age_days_max")
    held = claims.join(briefs.select("draft", "created"), "draft")
    age = F.abs(F.datediff("created", "published"))
    by = held.groupBy("draft").agg(
        F.count(F.lit(1)).alias("claims"), F.collect_set(F.col("id").cast("string")).alias("known"), n(factual).alias("factual"), n(factual & sourced).alias("backed"), n(sourced).alias("sourced"),
        n(sourced & (F.lower("source_tier") == "primary")).alias("primary"), n(sourced & F.col("http_status").isNotNull()).alias("checked"), n(sourced & ~F.col("http_status").between(200, 299)).alias("dead"),
        F.max("published").alias("newest"), n(F.col("volatile") & (age > most)).alias("stale"), n((F.lower("provenance") == "first_party") & F.col("artifact_id").isNotNull()).alias("own"),
    )
    rows = briefs.join(by, "draft", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b))
    ids = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    dangling, lacking = F.size(F.array_except(ids("cited"), ids("known"))), F.size(F.array_except(ids("mandated"), ids("cited")))
    least = F.when(F.coalesce("ymyl", F.lit(False)), F.lit(float(t.get("wrt11.sourced_share_min_ymyl")))).otherwise(float(t.get("wrt11.sourced_share_min")))
    apart = F.abs(F.datediff("byline", "newest"))
    live = F.try_divide(F.col("checked") - F.col("dead"), F.col("checked"))
    density = F.coalesce(F.try_divide(zero("own") * 1000.0, F.col("words")), F.lit(0.0))
    return judged(
        rows,
        rule("WRT-10", "BLOCK", failing(dangling > 0, "requires_agent"), F.size(F.array_distinct(ids("cited")))),
        rule("WRT-11", "BLOCK", F.when(share("backed", "factual").isNull(), "requires_input").otherwise(failing(share("backed", "factual") + EPSILON < least, "requires_agent")), F.round(share("backed", "factual"), 4), least),
        rule("WRT-12", "WARN", at_least(share("primary", "sourced"), t.get("wrt12.primary_source_ratio_min")), F.round(share("primary", "sourced"), 4), t.get("wrt12.primary_source_ratio_min")),
        rule("WRT-13", "BLOCK", F.when(live.isNull(), "requires_input").otherwise(failing((F.col("dead") > 0) | (F.col("checked") < F.col("sourced")))), F.round(live, 4), t.get("wrt13.link_liveness_min")),
        rule("WRT-14", "WARN", at_most(apart, t.get("wrt14.date_divergence_days_max")), apart, t.get("wrt14.date_divergence_days_max")),
        rule("WRT-15", "BLOCK", failing(zero("stale") > 0, "requires_agent"), zero("stale"), most),
        rule("WRT-16", "BLOCK", failing(lacking > 0), F.size(F.array_distinct(ids("mandated"))) - lacking, F.size(F.array_distinct(ids("mandated")))),
        rule("WRT-20", F.when(zero("own") == 0, "BLOCK").otherwise("WARN"), F.when(zero("own") == 0, "fail").otherwise(at_least(density, t.get("wrt20.ocd_min"))), F.round(density, 3), t.get("wrt20.ocd_min")),
        rule("WRT-26", "WARN", at_most(F.try_divide(F.col("words").cast("double"), F.col("claims")), t.get("wrt26.words_per_claim_max")), F.round(F.try_divide(F.col("words").cast("double"), F.col("claims")), 1), t.get("wrt26.words_per_claim_max")),
    )


def cited_claims(raw: Column) -> Column:
    """Claim ids that a draft cites: [[claim:x]] and {claim:x}; if there are none, bare claim:x."""
    marked = F.regexp_extract_all(raw, F.lit("(?:\\[\\[|\\{)claim:([A-Za-z0-9_\\-]+)(?:\\]\\]|\\})"), F.lit(1))
    bare = F.regexp_extract_all(raw, F.lit("\\bclaim:([A-Za-z0-9_\\-]+)"), F.lit(1))
    return F.array_distinct(F.when(F.size(marked) > 0, marked).otherwise(bare))


def identifier_rules(drafts: DataFrame) -> DataFrame:
    """WRT-17: book numbers with a wrong check digit."""
    found = F.regexp_extract_all(F.coalesce("raw", F.lit("")), F.lit("(?i)\\bISBN[:\\s]*([0-9][0-9\\-\\s]{8,20}[0-9Xx])"), F.lit(1))
    bad = F.size(F.filter(found, lambda x: ~isbn_valid(x)))
    return judged(drafts, rule("WRT-17", "BLOCK", failing(bad > 0), bad, 0))


def entity_rules(found: DataFrame, t: Thresholds, core: Sequence[str], top: Sequence[str]) -> DataFrame:
    """WRT-21, 22 and 33. ``draft``, ``found``, ``early``: entities in the text and in its first tokens. ``core``, ``top``: what most, and any, of the best pages have."""
    listed = lambda names: F.array(*[F.lit(x.lower()) for x in names]).cast("array<string>")
    gain = F.try_divide(F.size(F.array_except("found", listed(top))).cast("double"), F.size("found"))
    share = lambda c: F.try_divide(F.size(F.array_intersect(F.col(c), listed(core))).cast("double"), F.size(listed(core)))
    low, block, least, most = (t.get(f"wrt{k}") for k in ("21.entity_gain_warn", "21.entity_gain_block", "22.entity_coverage_min", "22.entity_coverage_max"))
    blocked = gain.isNull() | (gain + EPSILON < block)
    whole = share("found")
    return judged(
        found,
        rule("WRT-21", F.when(blocked, "BLOCK").otherwise("WARN"), at_least(gain, low), F.round(gain, 4), F.when(gain + EPSILON < block, block).otherwise(low)),
        rule("WRT-22", "WARN", F.when(whole.isNull(), "requires_input").otherwise(failing((whole + EPSILON < least) | (whole - EPSILON > most))), F.round(whole, 4), least),
        rule("WRT-33", "WARN", at_least(share("early"), t.get("wrt33.first_third_core_coverage_min")), F.round(share("early"), 4), t.get("wrt33.first_third_core_coverage_min")),
    )


def overlap_rules(drafts: DataFrame, overlaps: DataFrame, t: Thresholds) -> DataFrame:
    """WRT-23: the largest overlap with another text. ``drafts``: ``draft``, ``n_words``; ``overlaps``: ``draft``, ``overlap`` of the pairs that have one."""
    worst = overlaps.groupBy("draft").agg(F.max("overlap").alias("worst"))
    value = F.when(F.col("n_words") >= t.get("wrt23.ngram_n"), F.coalesce("worst", F.lit(0.0)))
    return judged(drafts.join(worst, "draft", "left"), rule("WRT-23", "BLOCK", at_most(value, t.get("wrt23.ngram_overlap_max"), "not_applicable"), F.round(value, 4), t.get("wrt23.ngram_overlap_max")))


def nearness_rules(briefs: DataFrame, t: Thresholds) -> DataFrame:
    """WRT-24 and 25. ``draft``, ``max_cosine`` with an existing page, ``drift`` from the site's centre."""
    return judged(
        briefs,
        rule("WRT-24", "BLOCK", at_most(F.col("max_cosine"), t.get("wrt24.cannibalization_cos_max"), "fail"), F.round("max_cosine", 4), t.get("wrt24.cannibalization_cos_max")),
        rule("WRT-25", "WARN", at_most(F.col("drift"), t.get("wrt25.site_drift_max")), F.round("drift", 4), t.get("wrt25.site_drift_max")),
    )


def structure_rules(units: DataFrame, t: Thresholds, anaphora: str | None = None) -> DataFrame:
    """WRT-30, 31, 32, 34 and 35 over parsed drafts. ``anaphora``: pattern of openers that lean on the text before."""
    raw = F.col("raw")
    types = [raw.rlike("(?m)^\\s*\\|.*\\|\\s*$"), raw.rlike("(?m)^\\s*(?:[-*+]|\\d+[.)])\\s+\\d+[.)]\\s+"), raw.rlike("\\$\\$|\\\\\\[|(?m)^\\s*\\|\\s*[-=+*/]\\s*\\|") | raw.rlike("\\b\\d+\\s*[×x*/]\\s*\\d+\\s*=\\s*\\d+"), raw.rlike("!\\[[^\\]]*\\]\\([^)]+\\)|<img\\b|```mermaid")]
    variety = sum((c.cast("int") for c in types), F.lit(0))
    skips = F.size(F.filter(F.transform("headings", lambda h, i: F.when(i > 0, h - F.get(F.col("headings"), i - 1))), lambda d: d > 1))
    openers = F.size(F.filter(section_openers(raw), lambda s: s.rlike(anaphora))) if anaphora else F.lit(None)
    return judged(
        units,
        rule("WRT-30", "WARN", "requires_agent", None, t.get("wrt30.time_to_answer_words_max")),
        rule("WRT-31", "WARN", "requires_agent", None, t.get("wrt31.passage_self_sufficiency_min")),
        rule("WRT-32", "BLOCK", F.when(openers.isNull(), "requires_input").otherwise(failing(openers > 0)), openers, 0),
        rule("WRT-34", "WARN", F.when(F.size("words") <= t.get("wrt34.long_document_words"), "not_applicable").otherwise(failing(variety < t.get("wrt34.structural_variety_min"))), variety, t.get("wrt34.structural_variety_min")),
        rule("WRT-35", "WARN", failing(skips > 0), skips, 0),
    )


def mode(values: Column) -> Column:
    """The most frequent value, of equal ones the first seen."""
    many = lambda v: F.size(F.filter(values, lambda x: x == v))
    return F.aggregate(F.array_distinct(values), F.struct(F.lit(0).alias("n"), F.lit(0).alias("v")), lambda acc, v: F.when(many(v) > acc["n"], F.struct(many(v).alias("n"), v.alias("v"))).otherwise(acc), lambda acc: acc["v"])


def form_rules(units: DataFrame, t: Thresholds) -> DataFrame:
    """WRT-40 to 46 over parsed drafts, each within its row."""
    size, window = F.size, int(t.get("wrt44.ttr_window_words"))
    lengths = F.transform("sentences", lambda s: size(tokens(s)))
    openers = F.filter(F.transform("sentences", lambda s: let(tokens(s), lambda w: F.when(size(w) >= 2, F.array_join(F.slice(w, 1, 2), " ")))), lambda o: o.isNotNull())
    starts = F.sequence(F.lit(0), F.greatest((size("words") - 1), F.lit(0)), F.lit(window))
    chunks = F.transform(starts, lambda i: F.slice("words", i + 1, window))
    counts = F.transform("paragraphs", lambda p: size(sentences(p)))
    groups = F.regexp_extract_all("kinds", F.lit("i+"), F.lit(0))
    held = units.select("draft", "words", "kinds", lengths.alias("lengths"), F.array_sort(openers).alias("openers"), counts.alias("counts"), groups.alias("groups"), chunks.alias("chunks"))
    n, one = F.size("lengths"), lambda x: x.cast("double")
    mean = F.aggregate("lengths", F.lit(0.0), lambda a, x: a + x) / n
    deviation = F.when(n >= 3, F.sqrt(F.aggregate("lengths", F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n))
    middle = F.try_divide(one(size(F.filter("lengths", lambda x: x.between(12, 22)))), n)
    same = let(F.col("counts"), lambda c: let(mode(c), lambda m: one(size(F.filter(c, lambda x: F.abs(x - m) <= 1))) / size(c)))
    uniform = F.when(size("counts") >= 3, same)
    twice = let(F.col("openers"), lambda o: one(size(F.filter(o, lambda x, i: (x == F.get(o, i + 1)) | ((i > 0) & (x == F.get(o, i - 1)))))) / size(o))
    repeated = F.when(size("openers") >= 5, F.coalesce(twice, F.lit(0.0)))
    ratio = lambda w: one(size(F.array_distinct(w))) / size(w)
    ratios = F.transform(F.filter("chunks", lambda c: size(c) >= min(window, 50)), ratio)
    ttr = F.when(size("words") > 0, F.coalesce(F.array_min(ratios), ratio(F.col("words"))))
    longest = F.array_max(F.transform(F.split("kinds", "p"), lambda s: F.regexp_count(s, F.lit("i+"))))
    three = F.try_divide(one(size(F.filter("groups", lambda g: F.length(g) == 3))), size("groups"))
    return judged(
        held,
        rule("WRT-40", "WARN", at_least(deviation, t.get("wrt40.sentence_length_sd_min")), F.round(deviation, 2), t.get("wrt40.sentence_length_sd_min")),
        rule("WRT-41", "WARN", at_most(middle, t.get("wrt41.mid_length_share_max")), F.round(middle, 4), t.get("wrt41.mid_length_share_max")),
        rule("WRT-42", "WARN", at_most(uniform, t.get("wrt42.uniform_paragraph_share_max")), F.round(uniform, 4), t.get("wrt42.uniform_paragraph_share_max")),
        rule("WRT-43", "WARN", at_most(repeated, t.get("wrt43.repeated_opener_share_max")), F.round(repeated, 4), t.get("wrt43.repeated_opener_share_max")),
        rule("WRT-44", "WARN", at_least(ttr, t.get("wrt44.ttr_min")), F.round(ttr, 4), t.get("wrt44.ttr_min")),
        rule("WRT-45", "WARN", failing(longest > t.get("wrt45.consecutive_lists_max")), longest, t.get("wrt45.consecutive_lists_max")),
        rule("WRT-46", "WARN", at_most(three, t.get("wrt46.rule_of_three_share_max"), "not_applicable"), F.round(three, 4), t.get("wrt46.rule_of_three_share_max")),
    )


def trace_rules(drafts: DataFrame) -> DataFrame:
    """WRT-50 to 53: marks of tools, their tracking, characters that can't be seen, Markdown in HTML."""
    raw = F.coalesce(F.col("raw"), F.lit(""))
    count = lambda pattern: F.regexp_count(raw, F.lit(pattern))
    unseen = sum((raw.contains(x.encode().decode("unicode_escape")).cast("int") for x in re.findall(r"\\u[0-9A-F]{4}", INVISIBLE)), F.lit(0))
    markdown = sum((raw.rlike(p).cast("int") for p in (r"\*\*[^*\n]{2,}\*\*", r"(?m)^#{1,6}\s+\S", r"\[[^\]]+\]\([^)]+\)", "```")), F.lit(0))
    leaks = F.when(is_html(raw), markdown).otherwise(0)
    return judged(drafts, *[rule(f"WRT-{i}", "BLOCK", failing(c > 0), c, 0) for i, c in ((50, count(TOOL_MARKS)), (51, count(f"(?i){TRACKING}")), (52, unseen), (53, leaks))])


def model_family(name: Column) -> Column:
    """The family of a model, else the name up to its first hyphen."""
    out = F.lower(F.btrim(name))
    family = F.coalesce(*[F.when(out.contains(f), f) for f in FAMILIES])
    return F.coalesce(family, F.element_at(F.split(out, "-"), 1))


def process_rules(state: DataFrame) -> DataFrame:
    """WRT-60 to 62. ``draft``, ``required`` and ``logged`` lenses, ``writer`` and ``judge`` models, ``published`` in the window and its ``cap``."""
    lacking = F.size(F.array_except("required", "logged"))
    return judged(
        state,
        rule("WRT-60", "BLOCK", F.when(F.col("logged").isNull(), "requires_input").otherwise(failing(lacking > 0)), F.when(F.col("logged").isNotNull(), lacking), 0),
        rule("WRT-61", "BLOCK", F.when(F.col("writer").isNull() | F.col("judge").isNull(), "requires_input").otherwise(failing(model_family(F.col("writer")) == model_family(F.col("judge"))))),
        rule("WRT-62", "BLOCK", F.when(F.col("published").isNull() | F.col("cap").isNull(), "requires_input").otherwise(failing(F.col("published") >= F.col("cap"))), F.col("published"), F.col("cap")),
    )


# Language packs.

RANK = {"INFO": 0, "WARN": 1, "BLOCK": 2}


def capped(declared: str | None, status: str, own: str | None = None) -> str:
    """Severity of a pack's entry: only a deterministic one may block, and an entry may lower its set's severity, never raise it."""
    declared = (declared or "WARN").upper()
    top = declared if declared in ("WARN", "INFO") or (declared == "BLOCK" and status == "deterministic") else "WARN"
    return own if own in RANK and RANK[own] < RANK[top] else top


def pack_rules(units: DataFrame, sets: Sequence[Mapping], t: Thresholds, defects: int = 0) -> DataFrame:
    """A LANG rule for each forbidding set of a pack, and WRT-06 for the pack's own defects.

    A set: ``rule_id``, ``severity``, ``density`` per 1000 words, ``scope``
    (document, section_first_sentence, document_tail) and ``entries`` of ``pattern``
    or ``named_check``, ``mode`` and ``status``. Packs are control data and go into the plan as literals.
    """
    tail = lambda text: let(lines(text), lambda x: F.array_join(F.slice(x, F.floor(F.size(x) * 0.85).cast("int") + 1, F.size(x)), "\n"))
    scopes = {"document": F.col("text"), "section_first_sentence": F.array_join(section_openers(F.col("raw")), "\n"), "document_tail": tail(F.col("text"))}
    words, rules = F.greatest(F.size("words"), F.lit(1)), []
    for s in sorted(sets, key=lambda x: x["rule_id"]):
        text, hits, blocked, measured = scopes[s.get("scope", "document")], F.lit(0), F.lit(False), F.lit(False)
        for e in s["entries"]:
            n = F.size(mixed_script(text)) if e.get("named_check") == "mixed_script_token" else F.regexp_count(text, F.lit(f"(?ium){e['pattern']}"))
            if e.get("mode") == "density":
                over = (n * 1000.0 / words - EPSILON > s["density"]) & (words >= t.get("lang.density_min_words")) if s.get("density") is not None else F.lit(False)
                hits, measured = hits + over.cast("int"), measured | ((n > 0) & ~over)
            else:
                hits = hits + (n > 0).cast("int")
                if capped(s.get("severity"), e.get("status", "hypothesis"), e.get("severity")) == "BLOCK":
                    blocked = blocked | (n > 0)
        quiet = (hits == 0) & measured
        calm = "WARN" if (s.get("severity") or "WARN").upper() == "BLOCK" else (s.get("severity") or "WARN").upper()
        rules.append(rule(s["rule_id"], F.when(blocked, "BLOCK").when(hits > 0, "WARN").when(quiet, "INFO").otherwise(calm), F.when(quiet, "not_applicable").otherwise(failing(hits > 0)), F.when(~quiet, hits), 0))
    return judged(units, *rules, rule("WRT-06", "WARN", "fail" if defects else "pass", F.lit(defects), 0))


def gate(results: DataFrame, observe: bool = False) -> DataFrame:
    """The verdict of each draft. ``observe`` downgrades what blocks to a warning."""
    severity = F.when(F.lit(observe) & (F.col("severity") == "BLOCK"), "WARN").otherwise(F.col("severity"))
    fail = F.col("status") == "fail"
    named = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("rule_id"))))
    open_ = F.col("rule_id").isin(*BLOCKING) & ~F.col("status").isin("pass", "not_applicable", "fail")
    by = results.groupBy("draft").agg(named(fail & (severity == "BLOCK")).alias("blocked_by"), named(open_).alias("unresolved"), named(fail & (severity == "WARN")).alias("warnings"))
    return by.withColumn("verdict", F.when(F.size("blocked_by") > 0, "BLOCK").when((F.size("unresolved") > 0) | (F.size("warnings") >= 2), "REWORK").otherwise("PASS"))
