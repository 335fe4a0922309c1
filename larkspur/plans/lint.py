"""Registered queries of the checks of a rule book, and their SQL. Parts stand for its lines, customers for sets of packs; the SQL knows what each line says."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.operators import lint as L
from larkspur.plans.queries import query, t

FILES = ["00-core.md", "05-write.md", "06-review.md", "08-measure.md", "lang/uk.md"]
def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _lines(spark, sf):
    """Twelve kinds of lines over five files."""
    k = F.col("p_partkey")
    own = F.concat(F.lit("WRT-"), (k % 90 + 10).cast("string"))
    kinds = [
        F.concat(F.lit("| "), own, F.lit(" | limit >= 5 | x |")), F.concat(F.lit("**"), own, F.lit(" (BLOCK).** Text [source: x] = 3")), F.concat(F.lit("see "), own, F.lit(" for P3 and P99")),
        "| row | MSR-11 | >= 4% |", "| row | MSR-11 | >= 4% [source: a] |", "| CRITICAL | thing |", "| HIGH | thing |", "look at `06-review.md` §2, `05-write.md` §9-1, `99-none.md`, `xx.md` and `draft.md`",
        "## 2. Section", "Nothing here", "### P3 Principle", "EVIDENCE.md#e10 P77 and bare P5",
    ]
    return t(spark, sf, "part").select(_pick(FILES, k % 5).alias("file"), k.cast("int").alias("line_no"), _pick(kinds, k % 12).alias("text"))


_L = f"l AS (SELECT CAST(p_partkey AS INTEGER) AS k, p_partkey % 12 AS kind, ({FILES!r})[p_partkey % 5 + 1] AS file, 'WRT-' || (p_partkey % 90 + 10) AS id FROM part)"


def says(check: str, severity: str, detail: str, source: str, where: str = "true", line: str = "k") -> str:
    return f"SELECT '{check}' AS \"check\", '{severity}' AS severity, file, CAST({line} AS INTEGER) AS line_no, {detail} AS detail FROM {source} WHERE {where}"


def both(*parts: str) -> str:
    return " UNION ALL ".join(parts)


@query(f"WITH {_L} " + both(says("rule_metadata", "warning", "id || ': no severity'", "l", "kind = 0"), says("rule_metadata", "warning", "id || ': number without source'", "l", "kind = 0")))
def lint_metadata(spark, sf):
    return L.rule_metadata(_lines(spark, sf), "06-review.md")


@query(f"WITH {_L}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, k) AS i FROM l WHERE kind < 2) " + both(says("duplicate_rule_id", "error", "id || ': foreign prefix'", "l", "kind < 2 AND file <> '05-write.md'"), says("duplicate_rule_id", "error", "id || ': declared again'", "n", "i > 1")))
def lint_owners(spark, sf):
    return L.rule_owners(_lines(spark, sf), {"WRT": "05-write.md"})


@query(f"WITH {_L} " + says("threshold_provenance", "warning", "'number without source'", "l", "kind = 3"))
def lint_provenance(spark, sf):
    return L.threshold_provenance(_lines(spark, sf))


@query(f"WITH {_L}, c AS (SELECT o_orderkey AS k, 'src/' || o_orderstatus AS file, 'WRT-' || (o_orderkey % 99) AS id FROM orders), m AS (SELECT * FROM c WHERE length(id) = 6 UNION ALL SELECT k, file, 'MSR-11' FROM c) " + says("code_doctrine_ids", "error", "id", "m", "id NOT IN (SELECT id FROM l WHERE kind < 2)"))
def lint_code(spark, sf):
    k = F.col("o_orderkey")
    code = t(spark, sf, "orders").select(F.concat(F.lit("src/"), F.col("o_orderstatus")).alias("file"), k.cast("int").alias("line_no"), F.concat(F.lit("# MSR-11, MSR-11 and WRT-"), (k % 99).cast("string")).alias("text"))
    return L.code_rules(code, _lines(spark, sf))


@query(f"WITH {_L} " + both(says("principle_reference", "error", "'P99'", "l", "kind = 2 AND file <> '00-core.md'"), says("principle_reference", "error", "'P5'", "l", "kind = 11 AND file <> '00-core.md'")))
def lint_principles(spark, sf):
    return L.principle_references(_lines(spark, sf), "00-core.md")


@query(f"WITH {_L} " + both(says("severity_vocabulary", "error", "'HIGH'", "l", "kind = 6 AND file <> '06-review.md'"), says("severity_vocabulary", "warning", "'CRITICAL'", "l", "kind = 5 AND file <> '06-review.md'")))
def lint_severities(spark, sf):
    return L.severity_vocabulary(_lines(spark, sf), "06-review.md")


@query(f"WITH {_L} " + both(says("cross_reference", "error", "'99-none.md'", "l", "kind = 7"), says("cross_reference", "warning", "'xx.md'", "l", "kind = 7"), says("cross_reference", "warning", "'05-write.md §9-1'", "l", "kind = 7")))
def lint_references(spark, sf):
    return L.cross_references(_lines(spark, sf))


def _gates(spark, sf):
    """Suppliers as fenced gates of five lines each, nations as the rules that are declared."""
    s = t(spark, sf, "supplier").select(F.concat(F.lit("g"), (F.col("s_suppkey") % 3).cast("string")).alias("file"), F.posexplode(F.array(*[F.lit(x) for x in ("```", "BLOCK ⟸ WRT-10..12, 15 (when x=0)", "  20, 99 and SEM-R7", "REWORK ⟸ 2 warnings, 77", "```")])).alias("_i", "text"), F.col("s_suppkey"))
    s = s.select("file", (F.col("s_suppkey") * 5 + F.col("_i")).cast("int").alias("line_no"), "text")
    n = t(spark, sf, "nation").select(F.lit("defs").alias("file"), F.col("n_nationkey").cast("int").alias("line_no"), F.concat(F.lit("**WRT-"), (F.col("n_nationkey") + 10).cast("string"), F.lit("** rule")).alias("text"))
    return s.unionByName(n)


@query("WITH g AS (SELECT 'g' || (s_suppkey % 3) AS file, s_suppkey * 5 + 1 AS k FROM supplier) " + both(says("composite_gate", "error", "'WRT-99'", "g"), says("composite_gate", "error", "'SEM-R7'", "g")))
def lint_gate(spark, sf):
    return L.gate_rules(_gates(spark, sf))


SETS = [*L.PACK_SETS, "russisms", "slang"]


def _sets(spark, sf):
    k = F.col("c_custkey")
    null = F.lit(None).cast("string")
    status = F.when(k % 6 == 0, null).when(k % 6 == 1, "deterministic").when(k % 6 == 2, "wrong").otherwise("observed")
    ident = F.when(k % 8 == 0, null).when(k % 8 == 1, "LANG-9").when(k % 8 == 2, "LANG-DE-01").otherwise(F.concat(F.lit("LANG-EN-"), (k % 70 + 100).cast("string")))
    due = F.when(k % 23 == 0, null).when(k % 3 == 0, "2020-01-01").otherwise("2099-01-01")
    return t(spark, sf, "customer").select(
        F.concat(F.lit("lang/p"), F.floor(k / 6).cast("string")).alias("file"), _pick(SETS, k % 9).alias("set"), k.cast("int").alias("line_no"), F.when(k % 11 != 0, F.lit(True)).alias("forbidden"), status.alias("default_status"),
        F.when(k % 13 == 0, "entries").otherwise("items").alias("items_key"), F.when(k % 17 == 0, "term").otherwise("phrase").alias("phrase_key"), F.when(k % 4 == 0, "BLOCK").otherwise("WARN").alias("severity"), F.when(k % 19 != 0, "2025-01-01").alias("updated_at"), due.alias("next_review"), ident.alias("rule_id"), F.lit("en").alias("code"),
    )


def _items(spark, sf):
    k = F.col("c_custkey")
    null = F.lit(None).cast("string")
    return t(spark, sf, "customer").select(
        F.concat(F.lit("lang/p"), F.floor(k / 6).cast("string")).alias("file"), _pick(SETS, k % 9).alias("set"), F.when(k % 10 != 0, "w").alias("phrase"), F.when(k % 29 == 0, "x").when(k % 3 == 0, null).when(k % 3 == 1, "hypothesis").otherwise("deterministic").alias("status"),
        F.when(k % 2 == 0, "high").otherwise("low").alias("risk"), F.when(k % 5 != 0, "n").alias("note"), F.when(k % 12 == 0, "mixed_script_token").when(k % 12 == 1, "other").alias("named_check"), F.when(k % 7 == 0, "(?=a)(?=b)").when(k % 7 == 1, "x").alias("match"),
    )


_S = f"s AS (SELECT CAST(c_custkey AS INTEGER) AS k, 'lang/p' || (c_custkey // 6) AS file, ({SETS!r})[c_custkey % 9 + 1] AS name FROM customer)"
_DEFAULT = "CASE k % 6 WHEN 0 THEN NULL WHEN 1 THEN 'deterministic' WHEN 2 THEN 'wrong' ELSE 'observed' END"
_OWN = "CASE WHEN k % 29 = 0 THEN 'x' WHEN k % 3 = 0 THEN NULL WHEN k % 3 = 1 THEN 'hypothesis' ELSE 'deterministic' END"
_KNOWN = "('hypothesis', 'observed', 'calibrated', 'deterministic')"


def of_set(check: str, severity: str, what: str, where: str, source: str = "s", line: str = "k") -> str:
    return says(check, severity, f"name || ': {what}'", source, where, line)


@query(f"WITH {_S} " + both(of_set("review_dates", "error", "no updated_at", "k % 19 = 0"), of_set("review_dates", "error", "no next_review", "k % 23 = 0"), of_set("review_dates", "warning", "due", "k % 23 <> 0 AND k % 3 = 0")))
def lint_reviews(spark, sf):
    return L.review_dates(_sets(spark, sf), "2026-01-01")


@query(f"WITH {_S} " + both(of_set("pack_block_severity", "error", "not deterministic", "k % 4 = 0 AND k % 6 <> 1"), of_set("pack_block_severity", "error", "entries override it", f"k % 4 = 0 AND k % 6 = 1 AND ({_OWN}) <> 'deterministic'")))
def lint_pack_severity(spark, sf):
    return L.pack_severity(_sets(spark, sf), _items(spark, sf))


@query(f"WITH {_S}, f AS (SELECT DISTINCT file FROM s), q AS (SELECT unnest({list(L.PACK_SETS)!r}) AS name), m AS (SELECT file, name FROM f, q EXCEPT SELECT file, name FROM s) " + both(
    of_set("pack_structure", "error", "missing", "true", "m", "1"), of_set("pack_structure", "error", "forbidden is not declared", "k % 11 = 0"), of_set("pack_structure", "error", "unknown status", "k % 6 = 2"), of_set("pack_structure", "error", "entries under another key", "k % 13 = 0"), of_set("pack_structure", "error", "phrases under another key", "k % 17 = 0"),
    of_set("pack_structure", "error", "entry without phrase", "k % 10 = 0"), of_set("pack_structure", "error", "entry without status", f"k % 10 <> 0 AND coalesce({_OWN}, {_DEFAULT}) IS NULL"), of_set("pack_structure", "error", "entry of unknown status", f"k % 10 <> 0 AND coalesce({_OWN}, {_DEFAULT}) NOT IN {_KNOWN}"), of_set("pack_structure", "warning", "risk without note", "k % 10 <> 0 AND k % 2 = 0 AND k % 5 = 0"),
))
def lint_pack_structure(spark, sf):
    return L.pack_structure(_sets(spark, sf), _items(spark, sf))


@query(f"WITH {_S}, i AS (SELECT *, row_number() OVER (PARTITION BY k % 70 ORDER BY file, name) AS n FROM s WHERE k % 8 > 2) " + both(of_set("pack_rule_ids", "error", "no rule_id", "k % 8 = 0"), of_set("pack_rule_ids", "error", "wrong form", "k % 8 = 1"), of_set("pack_rule_ids", "error", "another language", "k % 8 = 2"), of_set("pack_rule_ids", "error", "used before", "n > 1", "i")))
def lint_pack_ids(spark, sf):
    return L.pack_ids(_sets(spark, sf))


@query(f"WITH {_S} " + both(of_set("pack_patterns", "error", "unknown check", "k % 12 = 1"), of_set("pack_patterns", "warning", "check and pattern", "k % 12 < 2 AND k % 7 < 2"), of_set("pack_patterns", "error", "lookaheads at one place", "k % 12 > 1 AND k % 7 = 0")))
def lint_pack_patterns(spark, sf):
    return L.pack_patterns(_sets(spark, sf), _items(spark, sf))


@query("SELECT 'yaml_parses' AS \"check\", 'error' AS severity, 'n' || n_regionkey AS file, CAST(n_nationkey AS INTEGER) AS line_no, n_name AS detail FROM nation WHERE n_nationkey % 4 = 0")
def lint_blocks(spark, sf):
    return L.unreadable_blocks(t(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_regionkey").cast("string")).alias("file"), F.col("n_nationkey").alias("line_no"), F.when(F.col("n_nationkey") % 4 == 0, F.col("n_name")).alias("error")))


@query(f"WITH {_L}, v AS (SELECT 0 AS r, file, k, 'error [severity_vocabulary] HIGH' AS x FROM l WHERE kind = 6 AND file <> '06-review.md' UNION ALL SELECT 1, file, k, 'warning [severity_vocabulary] CRITICAL' FROM l WHERE kind = 5 AND file <> '06-review.md') SELECT CAST(row_number() OVER (ORDER BY r, file, k) AS INTEGER) AS n, file || ':' || k || ' ' || x AS text FROM v")
def lint_report(spark, sf):
    return L.report(L.severity_vocabulary(_lines(spark, sf), "06-review.md"))
