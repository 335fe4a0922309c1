"""Registered queries of the gate for drafts, and their SQL. Documents and pages stand for drafts, line items for claims, orders for briefs."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions.text import ABBREVIATIONS
from larkspur.operators import content as C
from larkspur.operators import drafts as D
from larkspur.plans.queries import _MARKS, _SCRIPTS, _UTM, ORACLES, SERIES, TOK, query, t

LIMITS = D.limits()
_EXTRA = ["", "\n\n# One\n\n### Two\n\n- a\n- b\n- c\n\n- d\nDr. Who came. It is, e.g. here.\n\n1. x\n2. y", "\n\n## Part\n\nThis is why. So it goes.\n\n| a | b |\n|---|---|\n\n2 x 3 = 6\n\n* one\n* two\n* three", "\n\n> quoted words\n\nISBN 978-3-16-148410-0 and ISBN 978-3-16-148410-1. etc. and so on.\n\n```\ncode here\n```"]


def _drafts(spark, sf):
    extra = F.element_at(F.array(*[F.lit(x) for x in _EXTRA]), (F.col("doc_id") % 4 + 1).cast("int"))
    return t(spark, sf, "documents").select(F.col("doc_id").alias("draft"), F.concat(F.coalesce("text", F.lit("")), extra).alias("raw"))


def lit(x: str) -> str:
    return "'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def re_all(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, '{pattern}')"


_RAW = f"d AS (SELECT doc_id AS draft, coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN {lit(_EXTRA[1])} WHEN 2 THEN {lit(_EXTRA[2])} ELSE {lit(_EXTRA[3])} END AS raw FROM documents)"
_HTML = "regexp_matches(raw, '(?i)<(p|div|article|h[1-6])\\b')"
_CLEAN = "regexp_replace(regexp_replace(regexp_replace(raw, '(?s)```.*?```', chr(10), 'g'), '(?m)^\\s*\\|.*\\|\\s*$', '', 'g'), '(?m)^\\s*>.*$', '', 'g')"
_PROSE = f"""p AS (SELECT draft, raw, trim(regexp_replace(regexp_replace(replace(replace(CASE WHEN {_HTML} THEN regexp_replace(a, '<[^>]+>', ' ', 'g') ELSE a END, chr(160), ' '), chr(8203), ''), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS text
  FROM (SELECT draft, raw, {_CLEAN} AS a FROM d))"""
_ITEM = "'^\\s*(?:[-*+]|\\d+[.)])\\s+.*$'"


def toks(x: str) -> str:
    return TOK.replace("coalesce(text, '')", x)


def sents(x: str) -> str:
    short = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    once = lambda y: f"regexp_replace({y}, '(?i)(^|\\s)((?:{short})\\.{{1,3}})\\s+', '\\1\\2' || chr(2), 'g')"
    # chr(2) stands for the blank after an abbreviation; the second pass sees it as one.
    twice = once(x).replace("(^|\\s)", "(^|[\\s\\x02])")
    twice = f"regexp_replace({twice}, '(?i)(^|[\\s\\x02])((?:{short})\\.{{1,3}})\\s+', '\\1\\2' || chr(2), 'g')"
    return f"list_filter(list_transform(string_split(regexp_replace({twice}, '([.!?…。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda z: replace(z, chr(2), ' ')), lambda z: trim(z, ' ') <> '')"


_LINES = "regexp_split_to_array({0}, '\\r?\\n')"
_UNITS = f"""u AS (SELECT draft, raw, text, {toks('text')} AS words, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda z: trim(z, ' ') <> '') AS paragraphs,
  {sents("array_to_string(list_filter(" + _LINES.format("text") + ", lambda z: NOT regexp_matches(z, " + _ITEM + ")), chr(10))")} AS sentences,
  array_to_string(list_transform({_LINES.format("raw")}, lambda z: CASE WHEN regexp_matches(z, {_ITEM}) THEN 'i' WHEN trim(z, ' ') = '' THEN 'b' ELSE 'p' END), '') AS kinds FROM p)"""


def row(rule: str, severity: str, status: str, value: str = "NULL", limit: object = "NULL", source: str = "f") -> str:
    severity = severity if severity.startswith("CASE") else f"'{severity}'"
    status = status if status.startswith("CASE") else f"'{status}'"
    return f"SELECT draft, '{rule}' AS rule_id, {severity} AS severity, {status} AS status, CAST({value} AS DOUBLE) AS \"value\", CAST({limit} AS DOUBLE) AS \"limit\" FROM {source}"


def below(value: str, limit: object, missing: str = "requires_input") -> str:
    return f"CASE WHEN {value} IS NULL THEN '{missing}' WHEN {value} + 1e-9 < {limit} THEN 'fail' ELSE 'pass' END"


def above(value: str, limit: object, missing: str = "requires_input") -> str:
    return f"CASE WHEN {value} IS NULL THEN '{missing}' WHEN {value} - 1e-9 > {limit} THEN 'fail' ELSE 'pass' END"


def bad(test: str, otherwise: str = "pass") -> str:
    return f"CASE WHEN {test} THEN 'fail' ELSE '{otherwise}' END"


_FORM = f"""WITH {_RAW}, {_PROSE}, {_UNITS},
l AS (SELECT draft, list_transform(sentences, lambda s: len({toks('s')})) AS n FROM u),
c AS (SELECT draft, unnest(list_transform(paragraphs, lambda q: len({sents('q')}))) AS n, unnest(range(len(paragraphs))) AS pos FROM u),
cm AS (SELECT draft, n, count(*) AS k, min(pos) AS f FROM c GROUP BY draft, n), top AS (SELECT draft, n AS m FROM (SELECT *, row_number() OVER (PARTITION BY draft ORDER BY k DESC, f) AS r FROM cm) WHERE r = 1),
un AS (SELECT c.draft AS draft, CASE WHEN count(*) >= 3 THEN CAST(count(*) FILTER (WHERE abs(n - m) <= 1) AS DOUBLE) / count(*) END AS v FROM c JOIN top ON c.draft = top.draft GROUP BY c.draft),
o AS (SELECT draft, o, count(*) AS k FROM (SELECT draft, unnest(list_transform(list_filter(list_transform(sentences, lambda s: {toks('s')}), lambda w: len(w) >= 2), lambda w: w[1] || ' ' || w[2])) AS o FROM u) GROUP BY draft, o),
re AS (SELECT draft, CASE WHEN sum(k) >= 5 THEN coalesce(sum(k) FILTER (WHERE k > 1), 0) / CAST(sum(k) AS DOUBLE) END AS v FROM o GROUP BY draft),
w AS (SELECT draft, unnest(words) AS w, unnest(range(len(words))) AS pos FROM u), k AS (SELECT draft, pos // 500 AS i, count(*) AS n, count(DISTINCT w) / CAST(count(*) AS DOUBLE) AS r FROM w GROUP BY draft, pos // 500),
tt AS (SELECT draft, coalesce(min(r) FILTER (WHERE n >= 50), min(r)) AS v FROM k GROUP BY draft),
g AS (SELECT draft, regexp_extract_all(kinds, 'i+') AS gs, list_max(list_transform(string_split(kinds, 'p'), lambda z: len(regexp_extract_all(z, 'i+')))) AS longest FROM u),
f AS (SELECT u.draft AS draft, CASE WHEN len(l.n) >= 3 THEN list_aggregate(l.n, 'stddev_pop') END AS sd, CASE WHEN len(l.n) > 0 THEN len(list_filter(l.n, lambda z: z BETWEEN 12 AND 22)) / CAST(len(l.n) AS DOUBLE) END AS mid, un.v AS uni, re.v AS rep, tt.v AS ttr, longest, CASE WHEN len(gs) > 0 THEN len(list_filter(gs, lambda z: length(z) = 3)) / CAST(len(gs) AS DOUBLE) END AS three
  FROM u JOIN l ON u.draft = l.draft LEFT JOIN un ON un.draft = u.draft LEFT JOIN re ON re.draft = u.draft LEFT JOIN tt ON tt.draft = u.draft JOIN g ON g.draft = u.draft)
""" + " UNION ALL ".join([
    row("WRT-40", "WARN", below("sd", 6.0), "round(sd, 2)", 6.0), row("WRT-41", "WARN", above("mid", 0.65), "round(mid, 4)", 0.65), row("WRT-42", "WARN", above("uni", 0.6), "round(uni, 4)", 0.6),
    row("WRT-43", "WARN", above("rep", 0.12), "round(rep, 4)", 0.12), row("WRT-44", "WARN", below("ttr", 0.38), "round(ttr, 4)", 0.38), row("WRT-45", "WARN", bad("longest > 2"), "longest", 2), row("WRT-46", "WARN", above("three", 0.5, "not_applicable"), "round(three, 4)", 0.5),
])


@query(_FORM)
def draft_form(spark, sf):
    return D.form_rules(D.parsed(_drafts(spark, sf)), LIMITS)


_SECTIONS = "list_filter(list_transform(regexp_split_to_array(raw, '(?m)^#{1,6}\\s+.*$')[2:], lambda b: coalesce((" + sents("trim(b, ' ' || chr(9) || chr(10) || chr(13))") + ")[1], '')), lambda z: z <> '')"
_OPENER = "(?i)^(this|it|these)\\b"
_TYPES = "CAST(regexp_matches(raw, '(?m)^\\s*\\|.*\\|\\s*$') AS INTEGER) + CAST(regexp_matches(raw, '(?m)^\\s*(?:[-*+]|\\d+[.)])\\s+\\d+[.)]\\s+') AS INTEGER) + CAST(regexp_matches(raw, '\\$\\$|\\\\\\[') OR regexp_matches(raw, '(?m)^\\s*\\|\\s*[-=+*/]\\s*\\|') OR regexp_matches(raw, '\\b\\d+\\s*[×x*/]\\s*\\d+\\s*=\\s*\\d+') AS INTEGER) + CAST(regexp_matches(raw, '!\\[[^\\]]*\\]\\([^)]+\\)|<img\\b|```mermaid') AS INTEGER)"
_STRUCTURE = f"""WITH {_RAW}, {_PROSE}, h AS (SELECT draft, list_transform(regexp_extract_all(raw, '(?m)^(#{{1,6}})\\s+.*?\\s*$', 1), lambda z: length(z)) AS hs FROM d),
f AS (SELECT p.draft AS draft, len({toks('text')}) AS n, {_TYPES} AS types, len(list_filter({_SECTIONS}, lambda z: regexp_matches(z, '{_OPENER}'))) AS openers, len(list_filter(list_zip(hs[1:len(hs)-1], hs[2:]), lambda z: z[2] - z[1] > 1)) AS skips FROM p JOIN h ON p.draft = h.draft)
""" + " UNION ALL ".join([
    row("WRT-30", "WARN", "requires_agent", limit=60), row("WRT-31", "WARN", "requires_agent", limit=0.9), row("WRT-32", "BLOCK", bad("openers > 0"), "openers", 0),
    row("WRT-34", "WARN", "CASE WHEN n <= 1200 THEN 'not_applicable' WHEN types < 2 THEN 'fail' ELSE 'pass' END", "types", 2), row("WRT-35", "WARN", bad("skips > 0"), "skips", 0),
])


@query(_STRUCTURE)
def draft_structure(spark, sf):
    return D.structure_rules(D.parsed(_drafts(spark, sf)), LIMITS, _OPENER)


_MARKDOWN = " + ".join(f"CAST(regexp_matches(raw, '{p}') AS INTEGER)" for p in ("\\*\\*[^*\\n]{2,}\\*\\*", "(?m)^#{1,6}\\s+\\S", "\\[[^\\]]+\\]\\([^)]+\\)", "```"))
_UNSEEN = " + ".join(f"CAST(contains(raw, chr({n})) AS INTEGER)" for n in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x202F, 0xAD, 0x2061))


@query(f"WITH d AS (SELECT page_id AS draft, html || CASE page_id % 5 WHEN 0 THEN ' turn3search9 **bold** ' || chr(8203) WHEN 1 THEN ' ?UTM_source=openai [x](y) [cite: 4]' ELSE '' END AS raw FROM pages), f AS (SELECT draft, len(regexp_extract_all(raw, '{_MARKS}')) AS a, len(regexp_extract_all(raw, '(?i){_UTM}')) AS b, {_UNSEEN} AS c, CASE WHEN {_HTML} THEN {_MARKDOWN} ELSE 0 END AS e FROM d) " + " UNION ALL ".join(row(f"WRT-{i}", "BLOCK", bad(f"{x} > 0"), x, 0) for i, x in ((50, "a"), (51, "b"), (52, "c"), (53, "e"))))
def draft_traces(spark, sf):
    tail = F.when(F.col("page_id") % 5 == 0, " turn3search9 **bold** ​").when(F.col("page_id") % 5 == 1, " ?UTM_source=openai [x](y) [cite: 4]").otherwise("")
    return D.trace_rules(t(spark, sf, "pages").select(F.col("page_id").alias("draft"), F.concat("html", tail).alias("raw")))


@query(f"WITH {_RAW}, b AS (SELECT draft, regexp_extract_all(raw, '(?i)\\bISBN[:\\s]*([0-9][0-9\\-\\s]{{8,20}}[0-9Xx])', 1) AS found FROM d), x AS (SELECT draft, list_transform(found, lambda z: regexp_replace(upper(z), '[^0-9X]', '', 'g')) AS ns FROM b), f AS (SELECT draft, len(list_filter(ns, lambda s: NOT CASE length(s) WHEN 10 THEN list_sum(list_transform(range(1, 11), lambda i: (11 - i) * CASE WHEN s[i] = 'X' THEN 10 ELSE CAST(s[i] AS INTEGER) END)) % 11 = 0 WHEN 13 THEN list_sum(list_transform(range(1, 14), lambda i: (CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) * TRY_CAST(s[i] AS INTEGER))) % 10 = 0 ELSE false END)) AS n FROM x) " + row("WRT-17", "BLOCK", bad("n > 0"), "n", 0))
def draft_identifiers(spark, sf):
    return D.identifier_rules(_drafts(spark, sf))


def _briefs(spark, sf):
    """Orders as briefs: which fields they fill follows from the key."""
    k = F.col("o_orderkey")
    names = [f for f in D.BRIEF_FIELDS if f != "unique_value_source"]
    filled = [x for i, f in enumerate(names) for x in (F.lit(f), F.when(k % (i + 11) != 0, F.lit("x")).otherwise(""))]
    kind = F.when(k % 3 == 0, "interview").when(k % 3 == 1, "export").otherwise("own_measurement")
    text = F.when(k % 7 == 0, "at least 900 words, please").when(k % 7 == 1, "Мінімум 500 слів").otherwise("short and clear")
    fields = F.create_map(*filled, F.lit("unique_value_source.kind"), kind, F.lit("unique_value_source.description"), F.when(k % 9 != 0, "d").otherwise(" "), F.lit("unique_value_source.artifact_id"), F.when(k % 4 != 0, (k % 50).cast("string")), F.lit("target.note"), text, F.lit("volume_expectation.text"), F.lit("1500 words"), F.when(k % 13 == 0, "min_words").otherwise("other"), F.lit("5"))
    return t(spark, sf, "orders").select(k.alias("draft"), fields.alias("fields"))


def _manifests(spark, sf):
    k = F.col("p_partkey")
    hashes = F.array(F.sha2(F.col("p_name"), 256), F.sha2(F.col("p_brand"), 256))
    stated = F.when(k % 6 == 0, F.array(F.lit("00"), F.element_at(hashes, 2))).when(k % 6 == 1, F.array(F.upper(F.element_at(hashes, 1)))).otherwise(hashes)
    found = F.when(k % 5 == 0, F.array().cast("array<string>")).when(k % 5 == 1, F.array(F.element_at(hashes, 1), F.lit(None).cast("string"))).otherwise(hashes)
    return t(spark, sf, "part").select(k.cast("string").alias("artifact_id"), F.when(k % 8 != 0, "survey").otherwise("rumour").alias("kind"), F.when(k % 9 == 0, "Agent 7").otherwise("J. Doe").alias("created_by"), F.when(k % 10 != 0, "asked").alias("method"), stated.alias("sha256"), found.alias("found"))


_MANIFEST = """m AS (SELECT CAST(p_partkey AS VARCHAR) AS artifact_id, CAST(p_partkey % 8 = 0 AS INTEGER) + CAST(p_partkey % 9 = 0 AS INTEGER) + CAST(p_partkey % 10 = 0 AS INTEGER) + CASE p_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 1 + CAST(p_partkey % 6 = 0 AS INTEGER) ELSE CAST(p_partkey % 6 = 0 AS INTEGER) END AS problems FROM part)"""


@query(f"WITH {_MANIFEST} SELECT artifact_id, CAST(problems AS INTEGER) AS problems FROM m")
def artifact_problems(spark, sf):
    return D.artifact_problems(_manifests(spark, sf))


_MISSING = " + ".join(f"CAST(k % {i + 11} = 0 AS INTEGER)" for i in range(11) if i != 3)  # the target has a note


@query(f"WITH {_MANIFEST}, b AS (SELECT o_orderkey AS k, o_orderkey AS draft, {_MISSING} AS missing, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderkey % 50 AS VARCHAR) END AS aid FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)), f AS (SELECT b.*, problems, CAST(k % 7 < 2 AS INTEGER) + CAST(k % 13 = 0 AS INTEGER) AS demands FROM b LEFT JOIN m ON m.artifact_id = b.aid) " + " UNION ALL ".join([
    row("WRT-01", "BLOCK", bad("missing > 0"), "12 - missing", 12), row("WRT-02", "BLOCK", bad("k % 3 = 1 OR k % 9 = 0")), row("WRT-03", "BLOCK", bad("aid IS NULL OR coalesce(problems, 1) > 0")), row("WRT-04", "BLOCK", bad("demands > 0"), "demands", 0), row("WRT-05", "BLOCK", "requires_agent"),
]))
def draft_briefs(spark, sf):
    return D.brief_rules(_briefs(spark, sf), D.artifact_problems(_manifests(spark, sf)))


def _claims(spark, sf):
    li = t(spark, sf, "lineitem")
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("fact", "figure", "opinion", "quote")]), (k % 4 + 1).cast("int"))
    claims = li.select(F.col("l_orderkey").alias("draft"), F.concat(F.lit("c"), n.cast("string")).alias("id"), kind.alias("kind"), F.when(k % 6 != 0, F.concat(F.lit("https://x/"), k.cast("string"))).alias("source_url"), F.when(k % 5 < 3, "Primary").otherwise("secondary").alias("source_tier"), F.when(k % 9 != 0, F.when(k % 10 == 0, 404).otherwise(200)).alias("http_status"), F.to_date("l_shipdate").alias("published"), (F.col("l_returnflag") == "R").alias("volatile"), F.when(k % 3 == 0, "first_party").otherwise("web").alias("provenance"), F.when(k % 2 == 0, "a").alias("artifact_id"))
    o = t(spark, sf, "orders")
    key = F.col("o_orderkey")
    raw = F.when(key % 5 == 0, "see claim:c1 and claim:c9").when(key % 5 == 1, "[[claim:c1]] {claim:c2} claim:c8").otherwise("{claim:c1} [[claim:c1]]")
    briefs = o.select(key.alias("draft"), (F.col("o_orderpriority") == "1-URGENT").alias("ymyl"), F.to_date("o_orderdate").alias("byline"), F.to_date("o_orderdate").alias("created"), (F.floor(F.col("o_totalprice") / 100) + 1).cast("int").alias("words"), D.cited_claims(raw).alias("cited"), F.when(key % 4 == 0, F.array(F.lit("c1"), F.lit("c2"))).otherwise(F.array().cast("array<string>")).alias("mandated"))
    return briefs, claims


_CLAIMS = """WITH o AS (SELECT o_orderkey AS draft, o_orderpriority = '1-URGENT' AS ymyl, CAST(o_orderdate AS DATE) AS byline, CAST(floor(o_totalprice / 100) AS INTEGER) + 1 AS words, CASE o_orderkey % 5 WHEN 0 THEN ['c1', 'c9'] WHEN 1 THEN ['c1', 'c2'] ELSE ['c1'] END AS cited, CASE WHEN o_orderkey % 4 = 0 THEN ['c1', 'c2'] ELSE [] END AS mandated FROM orders),
c AS (SELECT l_orderkey AS draft, 'c' || l_linenumber AS id, l_partkey % 4 <> 2 AS factual, l_partkey % 6 <> 0 AS sourced, l_partkey % 5 < 3 AS prim, l_partkey % 9 <> 0 AS checked, l_partkey % 10 = 0 AS dead, CAST(l_shipdate AS DATE) AS published, l_returnflag = 'R' AS volatile, l_partkey % 3 = 0 AND l_partkey % 2 = 0 AS own FROM lineitem),
b AS (SELECT c.draft AS draft, count(*) AS claims, list(DISTINCT id) AS known, count(*) FILTER (WHERE factual) AS factual, count(*) FILTER (WHERE factual AND sourced) AS backed, count(*) FILTER (WHERE sourced) AS sourced, count(*) FILTER (WHERE sourced AND prim) AS prim, count(*) FILTER (WHERE sourced AND checked) AS checked, count(*) FILTER (WHERE sourced AND checked AND dead) AS dead, max(published) AS newest, count(*) FILTER (WHERE volatile AND abs(date_diff('day', published, byline)) > 30) AS stale, count(*) FILTER (WHERE own) AS own FROM c JOIN o ON o.draft = c.draft GROUP BY c.draft),
f AS (SELECT o.*, claims, coalesce(own, 0) AS own, coalesce(stale, 0) AS stale, len(list_filter(cited, lambda z: NOT list_contains(coalesce(known, []), z))) AS dangling, len(list_filter(mandated, lambda z: NOT list_contains(cited, z))) AS lacking, CASE WHEN factual > 0 THEN backed / CAST(factual AS DOUBLE) END AS share, CASE WHEN ymyl THEN 1.0 ELSE 0.85 END AS least, CASE WHEN sourced > 0 THEN prim / CAST(sourced AS DOUBLE) END AS psr, CASE WHEN checked > 0 THEN (checked - dead) / CAST(checked AS DOUBLE) END AS live, dead, checked, sourced, abs(date_diff('day', newest, byline)) AS apart, coalesce(own, 0) * 1000.0 / words AS ocd, words / CAST(claims AS DOUBLE) AS wpc FROM o LEFT JOIN b ON b.draft = o.draft)
""" + " UNION ALL ".join([
    row("WRT-10", "BLOCK", bad("dangling > 0", "requires_agent"), "len(cited)"), row("WRT-11", "BLOCK", "CASE WHEN share IS NULL THEN 'requires_input' WHEN share + 1e-9 < least THEN 'fail' ELSE 'requires_agent' END", "round(share, 4)", "least"), row("WRT-12", "WARN", below("psr", 0.5), "round(psr, 4)", 0.5),
    row("WRT-13", "BLOCK", "CASE WHEN live IS NULL THEN 'requires_input' WHEN dead > 0 OR checked < sourced THEN 'fail' ELSE 'pass' END", "round(live, 4)", 1.0), row("WRT-14", "WARN", above("apart", 90), "apart", 90), row("WRT-15", "BLOCK", bad("stale > 0", "requires_agent"), "stale", 30),
    row("WRT-16", "BLOCK", bad("lacking > 0"), "len(mandated) - lacking", "len(mandated)"), row("WRT-20", "CASE WHEN own = 0 THEN 'BLOCK' ELSE 'WARN' END", "CASE WHEN own = 0 OR ocd + 1e-9 < 2.0 THEN 'fail' ELSE 'pass' END", "round(ocd, 3)", 2.0), row("WRT-26", "WARN", above("wpc", 250), "round(wpc, 1)", 250),
])


@query(_CLAIMS)
def draft_claims(spark, sf):
    return D.claim_rules(*_claims(spark, sf), LIMITS)


CORE, TOP = ["the", "with"], ["the", "apache license", "nicht"]
_NAMES = ["the", "apache license", "nicht", "pour", "with"]


def _inside(words: str) -> str:
    return f"list_filter({_NAMES!r}, lambda e: contains(' ' || array_to_string({words}, ' ') || ' ', ' ' || e || ' '))"


def _shared(a: str, b: list[str]) -> str:
    return f"len(list_intersect({a}, {b!r}))"


@query(f"WITH w AS (SELECT doc_id AS draft, {TOK} AS w FROM documents), e AS (SELECT draft, {_inside('w')} AS found, {_inside('w[1:greatest(1, CAST(floor(len(w) * 0.3) AS INTEGER))]')} AS early FROM w), f AS (SELECT draft, CASE WHEN len(found) > 0 THEN (len(found) - {_shared('found', TOP)}) / CAST(len(found) AS DOUBLE) END AS gain, {_shared('found', CORE)} / 2.0 AS cover, {_shared('early', CORE)} / 2.0 AS head FROM e) " + " UNION ALL ".join([
    row("WRT-21", "CASE WHEN gain IS NULL OR gain + 1e-9 < 0.08 THEN 'BLOCK' ELSE 'WARN' END", below("gain", 0.15), "round(gain, 4)", "CASE WHEN gain + 1e-9 < 0.08 THEN 0.08 ELSE 0.15 END"),
    row("WRT-22", "WARN", "CASE WHEN cover + 1e-9 < 0.7 OR cover - 1e-9 > 0.9 THEN 'fail' ELSE 'pass' END", "round(cover, 4)", 0.7), row("WRT-33", "WARN", below("head", 0.6), "round(head, 4)", 0.6),
]))
def draft_entities(spark, sf):
    found = C.entity_coverage(t(spark, sf, "documents"), _NAMES).withColumnRenamed("doc_id", "draft")
    return D.entity_rules(found, LIMITS, CORE, TOP)


def _grams(name: str, key: str, table: str) -> str:
    return f"{name} AS (SELECT DISTINCT {key} AS id, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 6)) AS i FROM (SELECT {key}, {TOK} AS w FROM {table}) WHERE len(w) >= 8))"


@query(f"WITH {_grams('ag', 'doc_id', 'documents')}, {_grams('bg', 'item_id', 'benchmark')}, n AS (SELECT id, count(*) AS n FROM ag GROUP BY id), s AS (SELECT ag.id AS id, bg.id AS item, count(*) AS k FROM ag JOIN bg ON ag.g = bg.g GROUP BY 1, 2), f AS (SELECT doc_id AS draft, CASE WHEN len({TOK}) >= 8 THEN coalesce(max(k) / CAST(max(n.n) AS DOUBLE), 0.0) END AS worst FROM documents LEFT JOIN s ON s.id = doc_id LEFT JOIN n ON n.id = doc_id GROUP BY doc_id, text) " + row("WRT-23", "BLOCK", above("worst", 0.03, "not_applicable"), "round(worst, 4)", 0.03))
def draft_overlap(spark, sf):
    docs = t(spark, sf, "documents")
    words = C.token_counts(docs).select(F.col("doc_id").alias("draft"), F.col("n_tokens").alias("n_words"))
    return D.overlap_rules(words, C.ngram_overlap(docs, t(spark, sf, "benchmark")).withColumnRenamed("doc_id", "draft"), LIMITS)


@query("WITH f AS (SELECT c_custkey AS draft, CASE WHEN c_custkey % 7 <> 0 THEN abs(c_acctbal) / 9973.0 END AS cos, CASE WHEN c_custkey % 5 <> 0 THEN abs(c_acctbal) / 19973.0 END AS drift FROM customer) " + " UNION ALL ".join([row("WRT-24", "BLOCK", above("cos", 0.85, "fail"), "round(cos, 4)", 0.85), row("WRT-25", "WARN", above("drift", 0.45), "round(drift, 4)", 0.45)]))
def draft_nearness(spark, sf):
    k = F.col("c_custkey")
    return D.nearness_rules(t(spark, sf, "customer").select(k.alias("draft"), F.when(k % 7 != 0, F.abs("c_acctbal") / 9973.0).alias("max_cosine"), F.when(k % 5 != 0, F.abs("c_acctbal") / 19973.0).alias("drift")), LIMITS)


@query("WITH s AS (SELECT c_custkey AS draft, c_custkey AS k FROM customer), f AS (SELECT draft, CASE k % 4 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 0 END AS lacking, CASE WHEN k % 6 = 0 THEN NULL ELSE k % 3 = 0 OR k % 5 = 1 END AS same, CASE WHEN k % 9 <> 0 THEN k % 12 END AS published FROM s) " + " UNION ALL ".join([
    row("WRT-60", "BLOCK", "CASE WHEN lacking IS NULL THEN 'requires_input' WHEN lacking > 0 THEN 'fail' ELSE 'pass' END", "lacking", 0), row("WRT-61", "BLOCK", "CASE WHEN same IS NULL THEN 'requires_input' WHEN same THEN 'fail' ELSE 'pass' END"), row("WRT-62", "BLOCK", "CASE WHEN published IS NULL THEN 'requires_input' WHEN published >= 10 THEN 'fail' ELSE 'pass' END", "published", 10),
]))
def draft_process(spark, sf):
    k = F.col("c_custkey")
    writer = F.when(k % 6 != 0, F.when(k % 3 == 0, "Llama-3-70b").when(k % 5 == 1, "inhouse-2").otherwise("mistral-large"))
    judge = F.when(k % 3 == 0, "meta llama 4").when(k % 5 == 1, "inhouse-9").otherwise("qwen-max")
    lenses = F.when(k % 4 == 0, F.lit(None).cast("array<string>")).when(k % 4 == 1, F.array(F.lit("facts"))).otherwise(F.array(F.lit("facts"), F.lit("style"), F.lit("law")))
    return D.process_rules(t(spark, sf, "customer").select(k.alias("draft"), F.array(F.lit("facts"), F.lit("style")).alias("required"), lenses.alias("logged"), writer.alias("writer"), judge.alias("judge"), F.when(k % 9 != 0, k % 12).alias("published"), F.lit(10).alias("cap")))


PACK = [
    {"rule_id": "LANG-EN-01", "severity": "BLOCK", "entries": [{"pattern": "licensed under", "status": "deterministic"}, {"named_check": "mixed_script_token", "status": "deterministic"}]},
    {"rule_id": "LANG-EN-02", "severity": "WARN", "density": 4.0, "entries": [{"pattern": "\\bthe\\b", "mode": "density"}]},
    {"rule_id": "LANG-EN-03", "severity": "INFO", "scope": "section_first_sentence", "entries": [{"pattern": "^this is", "status": "observed"}]},
    {"rule_id": "LANG-EN-04", "scope": "document_tail", "entries": [{"pattern": "so on", "status": "calibrated"}]},
]
_TAIL = "array_to_string((" + _LINES.format("text") + ")[CAST(floor(len(" + _LINES.format("text") + ") * 0.85) AS INTEGER) + 1:], chr(10))"


@query(f"WITH {_RAW}, {_PROSE}, x AS (SELECT draft, len({toks('text')}) AS n, CAST(len(regexp_extract_all(text, '(?im)licensed under')) > 0 AS INTEGER) + CAST(len(list_filter(regexp_extract_all(text, '\\p{{L}}+'), lambda w: {_SCRIPTS})) > 0 AS INTEGER) AS a, len(regexp_extract_all(text, '(?im)\\bthe\\b')) AS b, len(regexp_extract_all(array_to_string({_SECTIONS}, chr(10)), '(?im)^this is')) AS c, len(regexp_extract_all({_TAIL}, '(?im)so on')) AS e FROM p), f AS (SELECT draft, a, c, e, b, CAST(b * 1000.0 / greatest(n, 1) - 1e-9 > 4.0 AND n >= 300 AS INTEGER) AS over FROM x) " + " UNION ALL ".join([
    row("LANG-EN-01", "CASE WHEN a > 0 THEN 'BLOCK' ELSE 'WARN' END", bad("a > 0"), "a", 0), row("LANG-EN-02", "CASE WHEN over = 0 AND b > 0 THEN 'INFO' ELSE 'WARN' END", "CASE WHEN over = 1 THEN 'fail' WHEN b > 0 THEN 'not_applicable' ELSE 'pass' END", "CASE WHEN over = 1 OR b = 0 THEN over END", 0),
    row("LANG-EN-03", "CASE WHEN c > 0 THEN 'WARN' ELSE 'INFO' END", bad("c > 0"), "CAST(c > 0 AS INTEGER)", 0), row("LANG-EN-04", "WARN", bad("e > 0"), "CAST(e > 0 AS INTEGER)", 0), row("WRT-06", "WARN", "fail", "2", 0),
]))
def draft_packs(spark, sf):
    return D.pack_rules(D.parsed(_drafts(spark, sf)), PACK, LIMITS, defects=2)


_RULES = f"r AS (SELECT * FROM ({_CLAIMS}) UNION ALL SELECT * FROM (SELECT o_orderkey AS draft, 'WRT-45' AS rule_id, 'WARN' AS severity, CASE WHEN o_orderkey % 3 = 0 THEN 'fail' ELSE 'pass' END AS status, NULL AS v, NULL AS l FROM orders))"


def _gate_sql(severity: str) -> str:
    named = lambda test: f"list_sort(coalesce(list(DISTINCT rule_id) FILTER (WHERE {test}), []))"
    blocking = ", ".join(f"'{x}'" for x in D.BLOCKING)
    return f"WITH {_RULES}, s AS (SELECT draft, rule_id, status, {severity} AS severity FROM r), g AS (SELECT draft, {named("status = 'fail' AND severity = 'BLOCK'")} AS b, {named(f"status NOT IN ('pass', 'not_applicable', 'fail') AND rule_id IN ({blocking})")} AS u, {named("status = 'fail' AND severity = 'WARN'")} AS w FROM s GROUP BY draft) SELECT draft, array_to_string(b, ',') AS blocked_by, array_to_string(u, ',') AS unresolved, array_to_string(w, ',') AS warnings, CASE WHEN len(b) > 0 THEN 'BLOCK' WHEN len(u) > 0 OR len(w) >= 2 THEN 'REWORK' ELSE 'PASS' END AS verdict FROM g"


def _gated(spark, sf, observe):
    k = F.col("draft")
    briefs, claims = _claims(spark, sf)
    results = D.claim_rules(briefs, claims, LIMITS).unionByName(D.judged(briefs, D.rule("WRT-45", "WARN", D.failing(k % 3 == 0))))
    return D.gate(results, observe).select("draft", *[F.array_join(c, ",").alias(c) for c in ("blocked_by", "unresolved", "warnings")], "verdict")


@query(_gate_sql("severity"))
def draft_gate(spark, sf):
    return _gated(spark, sf, False)


@query(_gate_sql("CASE WHEN severity = 'BLOCK' THEN 'WARN' ELSE severity END"))
def draft_gate_observed(spark, sf):
    return _gated(spark, sf, True)


# SQL of queries that are registered elsewhere and read sentences, or the rows of others.

ORACLES["sentence_stats"] = f"WITH s AS (SELECT doc_id, unnest(list_transform({sents("coalesce(text, '')")}, lambda s: len({toks('s')}))) AS n FROM documents) SELECT doc_id, count(*) AS sentences, round(stddev_pop(n), 6) AS sigma, round(avg(CASE WHEN n BETWEEN 12 AND 22 THEN 1.0 ELSE 0.0 END), 6) AS mid_share FROM s WHERE n > 0 GROUP BY doc_id"
ORACLES["repeated_openers"] = f"WITH s AS (SELECT doc_id, unnest(list_transform({sents("coalesce(text, '')")}, lambda s: array_to_string(({toks('s')})[1:2], ' '))) AS o FROM documents), k AS (SELECT doc_id, o, count(*) AS n FROM s WHERE o <> '' GROUP BY 1, 2) SELECT doc_id, CAST(sum(n) AS BIGINT) AS sentences, round(coalesce(sum(n) FILTER (WHERE n > 1), 0) / CAST(sum(n) AS DOUBLE), 6) AS repeated_share FROM k GROUP BY doc_id HAVING sum(n) >= 5"
ORACLES["paragraph_mode"] = f"WITH a AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n+'), lambda z: trim(z, ' ') <> '') AS ps FROM documents), b AS (SELECT doc_id, unnest(list_transform(ps, lambda q: len({sents('q')}))) AS n, unnest(range(len(ps))) AS pos FROM a), k AS (SELECT doc_id, n, count(*) AS c, min(pos) AS f FROM b GROUP BY 1, 2), m AS (SELECT doc_id, n AS mode FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, f) AS i FROM k) WHERE i = 1) SELECT k.doc_id AS doc_id, CAST(mode AS INTEGER) AS mode, CAST(sum(c) AS BIGINT) AS paragraphs, round(coalesce(sum(c) FILTER (WHERE abs(n - mode) <= 1), 0) / CAST(sum(c) AS DOUBLE), 6) AS uniform_share FROM k JOIN m ON m.doc_id = k.doc_id GROUP BY k.doc_id, mode"
_OBSERVED = " UNION ALL ".join([
    f"SELECT 'striking' AS detector, 'MSR-23' AS rule_id, 'WARN' AS severity, query || ' → ' || page AS subject FROM ({ORACLES['striking']})", f"SELECT 'gaps', 'MSR-31', 'INFO', query FROM ({ORACLES['gaps']})", f"SELECT 'lost', 'MSR-28', 'WARN', query FROM ({ORACLES['lost']})",
    f"SELECT 'rising', 'MSR-26', 'INFO', subject FROM ({ORACLES['rising']})", f"SELECT 'decay', 'MSR-25', 'WARN', page FROM ({ORACLES['decay']})",
])
ORACLES["findings"] = f"WITH f AS ({_OBSERVED}), n AS (SELECT *, CAST(row_number() OVER (ORDER BY CASE severity WHEN 'WARN' THEN 1 ELSE 2 END, rule_id, subject) AS INTEGER) AS seq FROM f) SELECT CASE detector WHEN 'striking' THEN 'STRIKE' WHEN 'gaps' THEN 'GAP' ELSE upper(detector) END || '-' || lpad(CAST(seq AS VARCHAR), CAST(greatest(4, length(CAST(seq AS VARCHAR))) AS INTEGER), '0') AS id, seq, detector, rule_id, severity, subject FROM n"
ORACLES["findings_summary"] = f"SELECT detector, severity, count(*) AS n FROM ({_OBSERVED}) GROUP BY GROUPING SETS ((), (severity), (detector), (detector, severity))"
ORACLES["trend_ewma"] = f"WITH {SERIES}, o AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY date) - 1 AS i FROM s) SELECT b.term AS term, b.date AS date, CAST(b.value AS DOUBLE) AS value, round(sum((CASE WHEN a.i = 0 THEN 1.0 ELSE 0.25 END) * pow(0.75, b.i - a.i) * a.value), 4) AS ewma FROM o a JOIN o b ON a.term = b.term AND a.i <= b.i GROUP BY b.term, b.date, b.value"


def _ranked(rounds: int = 20) -> str:
    steps = "".join(f", r{i + 1} AS MATERIALIZED (SELECT v.node, (0.15 + 0.85 * (1 - (SELECT coalesce(sum(rank), 0) FROM r{i} WHERE node IN (SELECT src FROM g)))) / (SELECT count(*) FROM v) + 0.85 * coalesce(f.s, 0) AS rank FROM v LEFT JOIN (SELECT e.dst, sum(r{i}.rank / g.deg) AS s FROM e JOIN r{i} ON r{i}.node = e.src JOIN g ON g.src = e.src GROUP BY e.dst) f ON f.dst = v.node)" for i in range(rounds))
    return f"WITH e AS MATERIALIZED (SELECT DISTINCT * FROM (SELECT 'p' || CAST(l_partkey AS VARCHAR) AS src, 's' || CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem UNION ALL SELECT 's' || CAST(l_suppkey AS VARCHAR), 'p' || CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_quantity > 25)), v AS MATERIALIZED (SELECT src AS node FROM e UNION SELECT dst FROM e), g AS MATERIALIZED (SELECT src, count(*) AS deg FROM e GROUP BY src), r0 AS MATERIALIZED (SELECT node, 1.0 / (SELECT count(*) FROM v) AS rank FROM v){steps} SELECT node, round(CAST(rank AS DOUBLE), 8) AS rank, round(100.0 * rank / (SELECT max(rank) FROM r{rounds}), 4) AS link_score FROM r{rounds}"


ORACLES["page_rank"] = _ranked()
