"""Checks of a rule book and its language packs. Each gives rows (check, severity, file, line_no, detail).

Files are rows (``file``, ``line_no``, ``text``), sets of packs are rows of
their declared fields, entries rows of their set; a check is a filter, an
anti-join or a group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.content import rule_definitions, rule_mentions

#: Severities, verdicts of the review scale, words that are neither; sets that a pack must have, and states of entries.
SEVERITIES = ("BLOCK", "WARN", "INFO")
VERDICTS = ("BLOCKER", "HIGH", "NOTE")
NO_SEVERITIES = ("CRITICAL", "FATAL", "SEVERE", "MAJOR", "MINOR", "TRIVIAL")
PACK_SETS = ("anaphora_openers", "hedge_phrases", "closing_formulas", "promo_lexicon", "vague_attribution", "generational_stopwords", "prescribed_phrases")
STATUSES = ("hypothesis", "observed", "calibrated", "deterministic")
NAMED_CHECKS = ("mixed_script_token",)
#: What counts as a source of a number, as a number that is a limit, as a place for a severity.
PROVENANCE = r"(?i)\[\s*(source\s*:|expert judgement|expert judgment|owner decision|method\s*:)"
NUMBER = r"[=≥≤<>]\s*-?\d|(?<![\w.])-?\d+(\.\d+)?\s*%"
GRADED = r"\|\s*`?[A-Z]{4,8}`?\s*\||(?i:severity\s*[:=])|`[A-Z]{4,8}`|[A-Z]{3}-R?\d{1,3}[a-z]?\s*\(\s*[A-Z]{4,8}\s*\)"
BOTH_AHEAD = r"\(\?=(?![^)]*\|)[^)]{1,40}\)\s*\(\?="
RULE = r"\b[A-Z]{3}-R?\d{1,3}(?:\.\d{1,2})?[a-z]?\b"


def found(rows: DataFrame, check: str, severity: str | Column, detail: Column, line: Column | None = None) -> DataFrame:
    grade = severity if isinstance(severity, Column) else F.lit(severity)
    return rows.select(F.lit(check).alias("check"), grade.alias("severity"), "file", (F.col("line_no") if line is None else line).cast("int").alias("line_no"), detail.cast("string").alias("detail"))


def states_number(text: Column) -> Column:
    """Whether a line states a limit, rule ids, sections and sources aside."""
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, RULE, " "), "§\\s*\\d+(\\.\\d+)*", " "), "\\bEVIDENCE\\.md#\\S+", " ")
    return rest.rlike(NUMBER)


def table_row(text: Column) -> Column:
    return F.ltrim(text).startswith("|")


def unreadable_blocks(blocks: DataFrame) -> DataFrame:
    """``file``, ``line_no`` and ``error`` of every fenced block, null where it could be read."""
    return found(blocks.filter("error is not null"), "yaml_parses", "error", F.col("error"))


def rule_metadata(lines: DataFrame, review_file: str = "") -> DataFrame:
    """Rules that are declared without a severity, or in a table with a limit of no source."""
    declared = lines.join(rule_definitions(lines), ["file", "line_no"])
    text = F.col("text")
    graded = text.rlike("|".join(SEVERITIES)) | ((F.col("file") == review_file) & text.rlike("|".join(VERDICTS)))
    bare = found(declared.filter(~graded), "rule_metadata", "warning", F.concat(F.col("rule_id"), F.lit(": no severity")))
    unsourced = declared.filter(table_row(text) & states_number(text) & ~text.rlike(PROVENANCE))
    return bare.unionByName(found(unsourced, "rule_metadata", "warning", F.concat(F.col("rule_id"), F.lit(": number without source"))))


def rule_owners(lines: DataFrame, owners: Mapping[str, str]) -> DataFrame:
    """Rules that are declared twice, and outside the file that owns their prefix. ``owners``: prefix to file."""
    declared = rule_definitions(lines)
    owner = F.try_element_at(F.create_map(*[F.lit(x) for p in owners.items() for x in p]), F.regexp_extract("rule_id", "^([A-Z]+)-", 1))
    foreign = declared.filter(owner.isNull() | (owner != F.col("file")))
    twice = declared.groupBy("rule_id").agg(F.min(F.struct("file", "line_no")).alias("_first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = declared.join(twice, "rule_id").filter((F.col("file") != F.col("_first.file")) | (F.col("line_no") != F.col("_first.line_no")))
    return found(foreign, "duplicate_rule_id", "error", F.concat(F.col("rule_id"), F.lit(": foreign prefix"))).unionByName(found(again, "duplicate_rule_id", "error", F.concat(F.col("rule_id"), F.lit(": declared again"))))


def fenced(lines: DataFrame) -> DataFrame:
    """``lines`` with the number of the fenced block they lie in (``block``, null outside; fences themselves are outside)."""
    w = Window.partitionBy("file").orderBy("line_no")
    fence = F.ltrim("text").startswith("```")
    seen = F.sum(fence.cast("int")).over(w)
    return lines.withColumn("block", F.when(~fence & (seen % 2 == 1), F.floor(seen / 2).cast("int")))


def gate_ids(text: Column) -> Column:
    """Rule ids of a line of a gate as an array: XXX-01..05, 10, 20 means 01 to 05, 10 and 20 of the prefix before."""
    plain = F.regexp_replace(F.regexp_replace(text, "\\([^)]*\\)", " "), "\\d+\\.\\d+", " ")
    parts = F.transform(F.regexp_extract_all(plain, F.lit("(?:[A-Z]{3}-)?R?\\d{1,3}(?:\\s*\\.\\.\\s*\\d{1,3})?"), F.lit(0)), lambda x: F.struct(F.regexp_extract(x, "^([A-Z]{3})-", 1).alias("p"), F.regexp_extract(x, "^(?:[A-Z]{3}-)?(R?\\d{1,3})", 1).alias("a"), F.regexp_extract(x, "\\.\\.\\s*(\\d{1,3})", 1).alias("b")))

    def one(acc: Column, x: Column) -> Column:
        prefix = F.when(x["p"] != "", x["p"]).otherwise(acc["prefix"])
        last = F.when(x["b"] != "", x["b"]).otherwise(x["a"]).cast("int")
        made = F.when(x["a"].startswith("R"), F.array(x["a"])).otherwise(F.transform(F.sequence(x["a"].try_cast("int"), F.greatest(last, x["a"].try_cast("int"))), lambda n: F.lpad(n.cast("string"), F.greatest(F.length(x["a"]), F.length(n.cast("string"))), F.lit("0"))))
        ids = F.when(prefix == "", F.array().cast("array<string>")).otherwise(F.transform(made, lambda n: F.concat(prefix, F.lit("-"), n)))
        return F.struct(prefix.alias("prefix"), F.concat(acc["ids"], ids).alias("ids"))

    return F.aggregate(parts, F.struct(F.lit("").alias("prefix"), F.array().cast("array<string>").alias("ids")), one, lambda acc: acc["ids"])


def gate_rules(lines: DataFrame) -> DataFrame:
    """Rules that a composite gate names and nobody declares. Only the clause that blocks names rules; the clause goes on until the next one."""
    inside = fenced(lines).filter("block is not null")
    w = Window.partitionBy("file", "block").orderBy("line_no")
    clause = F.regexp_extract("text", "^\\s*(BLOCK|REWORK|PASS)\\b", 1)
    gates = inside.filter(F.col("text").rlike("^\\s*(BLOCK|REWORK|PASS)\\s*⟸")).select("file", "block").distinct()
    held = inside.join(gates, ["file", "block"], "left_semi").withColumn("_clause", F.last(F.when(clause != "", clause), ignorenulls=True).over(w))
    # A clause is one line of thought: its lines are read together, so that a bare number has its prefix.
    by = held.filter("_clause = 'BLOCK'").groupBy("file", "block").agg(F.min("line_no").alias("line_no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), " ").alias("_all"))
    named = by.select("file", "line_no", F.explode(F.array_distinct(gate_ids(F.col("_all")))).alias("rule_id"))
    return found(named.join(rule_definitions(lines).select("rule_id").distinct(), "rule_id", "left_anti"), "composite_gate", "error", F.col("rule_id"))


def review_dates(sets: DataFrame, today: str) -> DataFrame:
    """Sets without dates, and reviews that are due. ``file``, ``line_no``, ``set``, ``updated_at``, ``next_review``."""
    out = None
    for c in ("updated_at", "next_review"):
        part = found(sets.filter(F.col(c).isNull()), "review_dates", "error", F.concat(F.col("set"), F.lit(f": no {c}")))
        out = part if out is None else out.unionByName(part)
    return out.unionByName(found(sets.filter(F.col("next_review").try_cast("date") < F.lit(today).cast("date")), "review_dates", "warning", F.concat(F.col("set"), F.lit(": due"))))


def threshold_provenance(lines: DataFrame) -> DataFrame:
    """Rows of tables that name a rule which they don't declare, with a limit of no source."""
    text = F.col("text")
    rows = lines.filter(table_row(text) & text.rlike(RULE) & states_number(text) & ~text.rlike(PROVENANCE))
    return found(rows.join(rule_definitions(lines), ["file", "line_no"], "left_anti"), "threshold_provenance", "warning", F.lit("number without source"))


def code_rules(code: DataFrame, lines: DataFrame) -> DataFrame:
    """Rules that code names and the book doesn't declare."""
    return found(rule_mentions(code).join(rule_definitions(lines).select("rule_id").distinct(), "rule_id", "left_anti"), "code_doctrine_ids", "error", F.col("rule_id"))


def pack_severity(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Sets that block without being deterministic throughout. ``items``: ``file``, ``set``, ``phrase``, ``status``."""
    blocking = sets.filter("severity = 'BLOCK'")
    loose = blocking.filter(F.coalesce(F.col("default_status") != "deterministic", F.lit(True)))
    other = items.filter(F.coalesce(F.col("status") != "deterministic", F.lit(False))).select("file", "set").distinct()
    mixed = blocking.filter("default_status = 'deterministic'").join(other, ["file", "set"], "left_semi")
    return found(loose, "pack_block_severity", "error", F.concat(F.col("set"), F.lit(": not deterministic"))).unionByName(found(mixed, "pack_block_severity", "error", F.concat(F.col("set"), F.lit(": entries override it"))))


def pack_structure(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Sets that lack, undeclared fields, renamed keys, entries without phrase, status or note."""
    say = lambda rows, what, severity="error": found(rows, "pack_structure", severity, F.concat(F.col("set"), F.lit(f": {what}")))
    needed = F.array(*[F.lit(x) for x in PACK_SETS])
    lacking = sets.groupBy("file").agg(F.collect_set("set").alias("_have")).select("file", F.lit(1).alias("line_no"), F.explode(F.array_except(needed, "_have")).alias("set"))
    own = items.join(sets.select("file", "set", "line_no", "default_status"), ["file", "set"])
    status = F.coalesce("status", "default_status")
    parts = [
        say(lacking, "missing"), say(sets.filter("forbidden is null"), "forbidden is not declared"), say(sets.filter(~F.col("default_status").isin(*STATUSES)), "unknown status"),
        say(sets.filter("items_key <> 'items'"), "entries under another key"), say(sets.filter("phrase_key <> 'phrase'"), "phrases under another key"), say(own.filter("phrase is null"), "entry without phrase"),
        say(own.filter(F.col("phrase").isNotNull() & status.isNull()), "entry without status"), say(own.filter(F.col("phrase").isNotNull() & ~status.isin(*STATUSES)), "entry of unknown status"),
        say(own.filter(F.col("phrase").isNotNull() & F.col("risk").isin("critical", "high") & (F.coalesce("note", F.lit("")) == "")), "risk without note", "warning"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def principle_references(lines: DataFrame, home: str) -> DataFrame:
    """Bare P-numbers outside fences that ``home`` doesn't declare; those after a cited source belong to it."""
    declared = lines.filter(F.col("file") == home).select(F.regexp_extract("text", "^#{2,3}\\s+P(\\d{1,2})\\b", 1).alias("n")).filter("n <> ''").select(F.col("n").cast("int").alias("n")).distinct()
    outside = fenced(lines.filter(F.col("file") != home)).filter("block is null")
    plain = F.regexp_replace("text", "(EVIDENCE\\.md#\\S*|\\[internal observation, unpublished\\])[`\\s]*(?<![\\w/.-])P\\d{1,2}\\b", " ")
    used = outside.select("file", "line_no", F.explode(F.regexp_extract_all(plain, F.lit("(?<![\\w/.-])P(\\d{1,2})\\b"), F.lit(1))).alias("n")).select("file", "line_no", F.col("n").cast("int").alias("n"))
    return found(used.join(declared, "n", "left_anti"), "principle_reference", "error", F.concat(F.lit("P"), F.col("n").cast("string")))


def severity_vocabulary(lines: DataFrame, review_file: str) -> DataFrame:
    """Verdicts of the review scale outside its file, and words that are no severity, in the place of one. Files that declare a scale of their own are left alone."""
    own = lines.filter(F.col("text").rlike("^\\*\\*Severity meanings\\.\\*\\*")).select("file").distinct()
    rows = lines.filter((F.col("file") != review_file) & F.col("text").rlike(GRADED)).join(own, "file", "left_anti")
    excused = F.col("text").rlike("(?i)must not appear|no synonyms|is a review-scale|forbidden|not one of")
    used = lambda words, pattern: F.filter(F.array(*[F.when(F.col("text").rlike(pattern.replace("WORD", w)), F.lit(w)) for w in words]), lambda x: x.isNotNull())
    mapped = lambda w: F.col("text").rlike(f"`?{w}`?\\s*(→|->|maps to)")
    verdicts = F.filter(F.array(*[F.when(F.col("text").rlike(f"\\b{w}\\b") & ~mapped(w), F.lit(w)) for w in VERDICTS]), lambda x: x.isNotNull())
    one = rows.filter(~excused).select("file", "line_no", F.explode(verdicts).alias("w"))
    two = rows.select("file", "line_no", F.explode(used(NO_SEVERITIES, "(?<![\\w`])WORD(?![\\w`])")).alias("w"))
    return found(one, "severity_vocabulary", "error", F.col("w")).unionByName(found(two, "severity_vocabulary", "warning", F.col("w")))


def cross_references(lines: DataFrame, documents: str = "^[0-9]{2}-[a-z0-9-]+\\.md$|^[a-z]{2,3}\\.md$") -> DataFrame:
    """References to files that aren't there, and to sections that they don't have. ``documents``: names of files of the book; others are products."""
    names = lines.select(F.element_at(F.split("file", "/"), -1).alias("base")).distinct()
    sections = lines.select(F.element_at(F.split("file", "/"), -1).alias("base"), F.coalesce(F.nullif(F.regexp_extract("text", "^#{2,6}\\s+§?\\s*(\\d+(?:\\.\\d+)*)", 1), F.lit("")), F.regexp_extract("text", "^#{2,6}\\s+.*?§\\s*(\\d+(?:\\.\\d+)*)", 1)).alias("sec")).filter("sec <> ''").distinct()
    reference = "`(?:[a-z]+/)*[0-9A-Za-z_-]+\\.md`(?:\\s*§\\s*[\\d.]*\\d(?:-\\d+)?)?"
    used = lines.select("file", "line_no", F.explode(F.regexp_extract_all("text", F.lit(reference), F.lit(0))).alias("r")).select("file", "line_no", F.regexp_extract("r", "([0-9A-Za-z_-]+\\.md)`", 1).alias("base"), F.regexp_extract("r", "§\\s*([\\d.]+(?:-\\d+)?)$", 1).alias("sec")).filter(F.col("base").rlike(documents))
    gone = used.join(names, "base", "left_anti")
    planned = F.col("base").rlike("^[a-z]{2,3}\\.md$")
    numbered = used.filter("sec <> ''").join(sections.select("base").distinct(), "base", "left_semi").withColumn("_short", F.substring_index("sec", "-", 1))
    exact = sections.select("base", F.col("sec").alias("_have"))
    stale = numbered.join(exact, (numbered["base"] == exact["base"]) & ((F.col("sec") == F.col("_have")) | (F.col("_short") == F.col("_have"))), "left_anti")
    return found(gone, "cross_reference", F.when(planned, "warning").otherwise("error"), F.col("base")).unionByName(found(stale, "cross_reference", "warning", F.concat(F.col("base"), F.lit(" §"), F.col("sec"))))


def pack_ids(sets: DataFrame) -> DataFrame:
    """Sets without an id, of a wrong form, of another pack's language, or used before. ``code``: the pack's language."""
    say = lambda rows, what: found(rows, "pack_rule_ids", "error", F.concat(F.col("set"), F.lit(f": {what}")))
    named = sets.filter(F.coalesce("rule_id", F.lit("")) != "")
    form = "^LANG-([A-Z]{2,3})-\\d{2,3}$"
    right = named.filter(F.col("rule_id").rlike(form))
    home = right.filter(F.regexp_extract("rule_id", form, 1) == F.upper("code"))
    first = F.row_number().over(Window.partitionBy("rule_id").orderBy("file", "set"))
    parts = [say(sets.filter(F.coalesce("rule_id", F.lit("")) == ""), "no rule_id"), say(named.filter(~F.col("rule_id").rlike(form)), "wrong form"), say(right.filter(F.regexp_extract("rule_id", form, 1) != F.upper("code")), "another language"), say(home.withColumn("_n", first).filter("_n > 1"), "used before")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def pack_patterns(sets: DataFrame, items: DataFrame) -> DataFrame:
    """Entries that can't match: unknown named checks, a check and a pattern at once, two lookaheads at one place."""
    own = items.join(sets.select("file", "set", "line_no"), ["file", "set"])
    named = F.coalesce("named_check", F.lit("")) != ""
    say = lambda rows, severity, what: found(rows, "pack_patterns", severity, F.concat(F.col("set"), F.lit(f": {what}")))
    out = say(own.filter(named & ~F.col("named_check").isin(*NAMED_CHECKS)), "error", "unknown check")
    out = out.unionByName(say(own.filter(named & F.col("match").isNotNull()), "warning", "check and pattern"))
    return out.unionByName(say(own.filter(~named & F.coalesce("match", F.lit("")).rlike(BOTH_AHEAD)), "error", "lookaheads at one place"))


def report(violations: DataFrame) -> DataFrame:
    """Errors first, then by file, line, check and detail: ``text``, one line each, with its place in ``n``."""
    from larkspur.operators.graph import ordinal

    rank = F.when(F.col("severity") == "error", 0).otherwise(1)
    placed = ordinal(violations.withColumn("_rank", rank), "n", *[F.col(c) for c in ("_rank", "file", "line_no", "check", "detail")])
    return placed.select("n", F.concat_ws(" ", F.concat_ws(":", "file", F.col("line_no").cast("string")), "severity", F.concat(F.lit("["), F.col("check"), F.lit("]")), "detail").alias("text"))


def exit_code(violations: DataFrame, strict: bool = False) -> int:
    """2 with errors, 1 with warnings if they count, else 0."""
    seen = {row["severity"] for row in violations.select("severity").distinct().collect()}
    return 2 if "error" in seen else 1 if strict and seen else 0


def rows_of(spark, files: Mapping[str, str] | Sequence[tuple[str, str]]) -> DataFrame:
    """Lines of small files given as name to text."""
    pairs = files.items() if isinstance(files, Mapping) else files
    return spark.createDataFrame([(name, i, line) for name, text in pairs for i, line in enumerate(text.splitlines(), 1)], "file string, line_no int, text string")
