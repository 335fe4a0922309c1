"""Text rules over drafts, phrase packs, and lint relations over a rule book."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.text import INVISIBLE, TOOL_MARKS, TRACKING, let, mixed_script, ngrams, sentences, tokens


def token_counts(docs: DataFrame) -> DataFrame:
    words = tokens(F.col("text"))
    return docs.select("doc_id", words.alias("_w")).select("doc_id", F.size("_w").alias("n_tokens"), F.size(F.array_distinct("_w")).alias("n_distinct"))


def sentence_stats(docs: DataFrame) -> DataFrame:
    """Per document: sentences, population deviation of their length in words, share of 12 to 22 words."""
    lengths = F.transform(sentences(F.col("text")), lambda s: F.size(tokens(s)))
    one = docs.select("doc_id", F.explode(lengths).alias("n")).filter("n > 0")
    return one.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.stddev_pop("n").alias("sigma"), F.avg(F.col("n").between(12, 22).cast("double")).alias("mid_share"))


def type_token_ratio(docs: DataFrame, chunk: int = 500, least: int = 50) -> DataFrame:
    """Least share of distinct words over chunks that don't overlap; chunks under ``least`` words don't count."""
    one = docs.select("doc_id", F.posexplode(tokens(F.col("text"))).alias("p", "w"))
    by = one.groupBy("doc_id", F.floor(F.col("p") / chunk).alias("chunk")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("w").alias("d")).filter(F.col("n") >= least)
    return by.groupBy("doc_id").agg(F.min(F.col("d") / F.col("n")).alias("min_ttr"), F.count(F.lit(1)).alias("chunks"))


def repeated_openers(docs: DataFrame, least: int = 5) -> DataFrame:
    """Share of sentences whose first two words open another sentence too."""
    opener = F.transform(sentences(F.col("text")), lambda s: F.array_join(F.slice(tokens(s), 1, 2), " "))
    one = docs.select("doc_id", F.explode(opener).alias("o")).filter("o <> ''")
    by = one.groupBy("doc_id", "o").agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("doc_id").agg(F.sum("n").alias("sentences"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("repeated_share")).filter(F.col("sentences") >= least)


def paragraph_mode(docs: DataFrame) -> DataFrame:
    """Most frequent number of sentences in a paragraph (of equal ones the first seen), and the share within one of it."""
    one = docs.select("doc_id", F.posexplode(F.filter(F.split("text", "\\n+"), lambda p: F.btrim(p) != "")).alias("p", "par")).select("doc_id", "p", F.size(sentences(F.col("par"))).alias("n"))
    by = one.groupBy("doc_id", "n").agg(F.count(F.lit(1)).alias("c"), F.min("p").alias("first"))
    top = by.groupBy("doc_id").agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "n")).alias("m")).select("doc_id", F.col("m.n").alias("mode"))
    return by.join(top, "doc_id").groupBy("doc_id", "mode").agg(F.sum("c").alias("paragraphs"), (F.sum(F.when(F.abs(F.col("n") - F.col("mode")) <= 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("uniform_share"))


def ngram_overlap(docs: DataFrame, others: DataFrame, n: int = 8) -> DataFrame:
    """Share of a document's n-grams that another text has, for every pair with one in common. ``others``: item_id, text.

    Grams are 64-bit hashes; those that no other text has leave before any join
    by shuffle when the others are few, and the pairs are counted map-side.
    """
    a = docs.select("doc_id", ngrams(tokens(F.col("text")), n).alias("_g")).select("doc_id", F.size("_g").alias("n_grams"), F.explode("_g").alias("g"))
    b = others.select("item_id", F.explode(ngrams(tokens(F.col("text")), n)).alias("g"))
    hit = a.join(b, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"), F.first("n_grams").alias("n_grams"))
    return hit.withColumn("overlap", F.col("shared") / F.col("n_grams"))


def entity_coverage(docs: DataFrame, entities: Sequence[str]) -> DataFrame:
    """Which entities (runs of tokens) a text has: documents, entity, found in the first 30 % of the tokens."""
    listed = F.array(*[F.lit(e.lower()) for e in entities])
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    inside = lambda text: F.filter(listed, lambda e: F.contains(text, F.concat(F.lit(" "), e, F.lit(" "))))
    early = lambda w: F.slice(w, 1, F.greatest(F.lit(1), F.floor(F.size(w) * 0.3).cast("int")))
    both = lambda w: F.struct(let(spaced(w), inside).alias("found"), let(spaced(early(w)), inside).alias("early"))
    return docs.select("doc_id", let(tokens(F.col("text")), both).alias("_e")).select("doc_id", "_e.found", "_e.early")


def core_entities(found: DataFrame) -> DataFrame:
    """Entities that at least half of the documents have. ``found``: doc_id, found."""
    n = found.agg(F.count_distinct("doc_id").alias("docs"), F.lit(1).alias("k"))
    df = found.select("doc_id", F.explode("found").alias("entity")).groupBy("entity").agg(F.count_distinct("doc_id").alias("df"), F.lit(1).alias("k"))
    return df.join(F.broadcast(n), "k").filter(F.col("df") * 2 >= F.col("docs")).select("entity", "df")


def markers(docs: DataFrame) -> DataFrame:
    """Marks of tools, tracking parameters, characters that can't be seen and tokens of two scripts."""
    return docs.select("doc_id", F.regexp_count("text", F.lit(TOOL_MARKS)).alias("tool_marks"), F.regexp_count("text", F.lit(TRACKING)).alias("tracking"), F.regexp_count("text", F.lit(INVISIBLE)).alias("invisible"), F.size(mixed_script(F.col("text"))).alias("mixed_script"))


def heading_skips(headings: DataFrame) -> DataFrame:
    """Headings more than one level below the one before. ``doc_id``, ``pos``, ``level``."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    return headings.withColumn("before", F.lag("level").over(w)).filter("level - before > 1")


def list_runs(lines: DataFrame) -> DataFrame:
    """Longest run of lists without prose between. ``doc_id``, ``pos``, ``kind`` (prose, item, blank)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    starts = (F.col("kind") == "item") & (F.coalesce(F.lag("kind").over(w), F.lit("blank")) != "item")
    island = F.sum((F.col("kind") == "prose").cast("int")).over(w)
    return lines.withColumn("start", starts).withColumn("island", island).groupBy("doc_id", "island").agg(F.sum(F.col("start").cast("int")).alias("lists")).groupBy("doc_id").agg(F.max("lists").alias("longest_run"))


def protected(match_at: Column, spans: Column) -> Column:
    """Whether an offset lies in one of the spans (start, end); both refer to the same text."""
    return F.exists(spans, lambda s: (match_at >= s["start"]) & (match_at < s["end"]))


def parse_pack(markdown: str) -> list[dict]:
    """Entries of the YAML fences of a pack: set, phrase, severity, forbidden, density, mode. Read on the driver, packs are small files."""
    import yaml

    out = []
    for body in re.findall(r"```ya?ml\n(.*?)```", markdown, re.S):
        loaded = yaml.safe_load(body) or {}
        for name, group in (loaded.get("sets") or loaded).items():
            if not isinstance(group, Mapping):
                continue
            for item in group.get("items") or group.get("entries") or []:
                item = {"phrase": item} if isinstance(item, str) else item
                out.append({"set": name, "phrase": str(item.get("phrase") or item.get("term") or ""), "severity": item.get("severity") or group.get("severity", "WARN"), "forbidden": bool(group.get("forbidden", True)), "density": group.get("density"), "mode": item.get("match_mode") or "phrase"})
    return out


def pack_hits(docs: DataFrame, entries: Sequence[Mapping], least_words: int = 300) -> DataFrame:
    """Hits of every pack entry in every text, and per 1000 words. The pack is a small file and goes into the plan as literals; the text is read once."""
    found = []
    for e in entries:
        pattern = e["phrase"] if e.get("mode") == "regex" else re.escape(e["phrase"]).replace("\\ ", "\\s+")
        pattern = pattern if e.get("mode") == "regex" else f"(?<![\\p{{L}}\\p{{N}}]){pattern}(?![\\p{{L}}\\p{{N}}])"
        found.append(F.struct(F.lit(e["set"]).alias("set"), F.lit(e["phrase"]).alias("phrase"), F.lit(e.get("severity", "WARN")).alias("severity"), F.regexp_count(F.coalesce("text", F.lit("")), F.lit(f"(?ium){pattern}")).alias("hits")))
    words = F.size(tokens(F.col("text")))
    out = docs.select("doc_id", words.alias("n_words"), F.explode(F.array(*found)).alias("e")).select("doc_id", "n_words", "e.*").filter("hits > 0")
    return out.withColumn("per_1000", F.when(F.col("n_words") >= least_words, 1000.0 * F.col("hits") / F.col("n_words")))


def claim_rules(claims: DataFrame) -> DataFrame:
    """Shares over the claims of each draft. ``draft``, ``kind``, ``tier``, ``http_status``, ``first_party``."""
    factual = F.col("kind") == "factual"
    sourced = factual & F.col("tier").isNotNull()
    n = lambda c: F.sum(c.cast("int"))
    return claims.groupBy("draft").agg(F.try_divide(n(sourced).cast("double"), n(factual).cast("double")).alias("sourced_share"), F.try_divide(n(sourced & (F.col("tier") == "primary")).cast("double"), n(sourced).cast("double")).alias("primary_share"), n(F.col("http_status").isNull() | ~F.col("http_status").between(200, 299)).alias("dead"), n(F.coalesce("first_party", F.lit(False))).alias("first_party"))


def verdict(results: DataFrame) -> DataFrame:
    """BLOCK if a blocking rule fails, REWORK if anything is unresolved or two rules warn, else PASS. Only ``pass`` passes. ``draft``, ``rule_id``, ``severity``, ``status``."""
    fail = F.col("status") == "fail"
    by = results.groupBy("draft").agg(F.sort_array(F.collect_set(F.when(fail & (F.col("severity") == "BLOCK"), F.col("rule_id")))).alias("blocked_by"), F.sum((fail & (F.col("severity") == "WARN")).cast("int")).alias("warned"), F.sum(F.col("status").isin("requires_agent", "requires_input").cast("int")).alias("unresolved"))
    return by.withColumn("verdict", F.when(F.size("blocked_by") > 0, "BLOCK").when((F.col("unresolved") > 0) | (F.col("warned") >= 2), "REWORK").otherwise("PASS"))


# Lint relations: files are rows (file, line_no, text).

RULE = "\\b([A-Z]{2,5}-\\d{2})\\b"


def rule_definitions(lines: DataFrame) -> DataFrame:
    """Lines that declare a rule: a bold id at the start of a line or table cell, or a heading. Lines with a range define nothing."""
    m = F.regexp_extract("text", "^\\s*(?:\\|\\s*|#{1,6}\\s+|>\\s*|[-*]\\s+)?[*`]*([A-Z]{2,5}-\\d{2})\\b(?!\\s*(?:\\.\\.|–|-)\\s*\\d)", 1)
    return lines.withColumn("rule_id", m).filter("rule_id <> ''").select("file", "line_no", "rule_id")


def rule_mentions(lines: DataFrame) -> DataFrame:
    return lines.select("file", "line_no", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RULE), F.lit(1)))).alias("rule_id"))


def undefined_rules(mentions: DataFrame, definitions: DataFrame) -> DataFrame:
    return mentions.join(definitions.select("rule_id").distinct(), "rule_id", "left_anti")


def duplicate_rules(definitions: DataFrame) -> DataFrame:
    return definitions.groupBy("rule_id").agg(F.count_distinct("file").alias("files"), F.min("file").alias("first_file")).filter("files > 1")


def threshold_homes(keys: DataFrame) -> DataFrame:
    """Keys with more than one value. ``key``, ``value``, ``file``."""
    return keys.groupBy("key").agg(F.count_distinct("value").alias("values"), F.count_distinct("file").alias("files")).filter("values > 1")


def prescribed_forbidden(entries: DataFrame) -> DataFrame:
    """Phrases that one set prescribes and another forbids. ``set``, ``phrase``, ``forbidden``. A set's entries of one phrase count once before they are paired."""
    norm = F.regexp_replace(F.lower(F.btrim("phrase")), "\\s+", " ").alias("norm")
    yes = entries.filter("not forbidden").select(norm, F.col("set").alias("prescribed_by")).distinct()
    no = entries.filter("forbidden").select(norm, F.col("set").alias("forbidden_by")).distinct()
    return yes.join(no, "norm")


def suppressed(violations: DataFrame, suppressions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Violations that no suppression covers (those of the suppressions check can't be covered), and suppressions that cover nothing."""
    keys = ["file", "line_no", "check"]
    s = suppressions.filter("check <> 'suppressions'")
    return violations.join(s.select(*keys).distinct(), keys, "left_anti"), suppressions.join(violations.select(*keys).distinct(), keys, "left_anti")


def expand_ids(prefix: str, first: int, last: int) -> list[str]:
    return [f"{prefix}-{i:02d}" for i in range(first, last + 1)]
