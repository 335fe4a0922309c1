"""Text functions as columns. NFC and case folding have no Spark built-in and are Arrow UDFs; the rest stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Letters with inner apostrophes or hyphens, or numbers with inner points and commas.
WORD = "[\\p{L}\\p{Nl}\\p{No}]+(?:[’'ʼ\\-][\\p{L}\\p{Nl}\\p{No}]+)*|\\p{Nd}+(?:[.,]\\p{Nd}+)*"
#: The letters of the two scripts that look alike.
CYRILLIC, LATIN = "[\\u0400-\\u04FF\\u0500-\\u052F\\u2DE0-\\u2DFF\\uA640-\\uA69F]", "[A-Za-z\\u00C0-\\u024F]"
#: Marks that writing tools leave behind, tracking parameters that they add, and characters that can't be seen.
TOOL_MARKERS = {
    "contentReference": "contentReference",
    "oai_citation": "oai_citation",
    "turn_search": "turn\\d+search\\d+",
    "attributableIndex": "attributableIndex",
    "cite_marker": "\\[cite:\\s*\\d+\\]",
    "span_marker": "\\[span_\\d+\\]\\(start_span\\)",
    "grok_card": "grok_card",
    "ppl_file_upload": "ppl-ai-file-upload",
    "attached_file": "attached_file",
    "writing_fence": ":::writing",
}
GENERATOR_UTM = ("utm_source=chatgpt\\.com", "utm_source=openai", "utm_source=perplexity")
INVISIBLE_CHARS = ("\\u200B", "\\u200C", "\\u200D", "\\u2060", "\\uFEFF", "\\u202F", "\\u00AD", "\\u2061")
TOOL_MARKS, TRACKING, INVISIBLE = "|".join(TOOL_MARKERS.values()), "|".join(GENERATOR_UTM), f"[{''.join(INVISIBLE_CHARS)}]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once for a row, however often ``use`` refers to it, lambdas included."""
    return F.element_at(F.transform(F.array(value), use), 1)


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    return text.map(lambda x: unicodedata.normalize("NFC", x).casefold(), na_action="ignore")


def normalize_text(text: Column) -> Column:
    """NFC, no-break space as space, no zero-width space, single blanks, at most one empty line, trimmed."""
    out = F.regexp_replace(F.regexp_replace(nfc(text), " ", " "), "​", "")
    out = F.regexp_replace(F.regexp_replace(out, "[ \\t]+", " "), "\\n{3,}", "\n\n")
    return F.btrim(out, F.lit(" \t\n\r\x0b\x0c"))


def normalize_query(text: Column) -> Column:
    """NFC, folded case, words joined by one space. A null stays null, blanks become empty (an anonymised query)."""
    return F.btrim(F.regexp_replace(folded(text), "\\s+", " "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


#: Abbreviations whose point ends no sentence.
ABBREVIATIONS = ("e.g", "i.e", "etc", "vs", "mr", "mrs", "ms", "dr", "prof", "inc", "ltd", "co", "fig", "no", "напр", "т.д", "т.п", "тис", "млн", "млрд", "грн", "вул", "проф", "др", "рис", "ст")
_SHORT = "|".join(x.replace(".", "\\.") for x in ABBREVIATIONS)


def sentences(text: Column) -> Column:
    """Split after a terminator and white space, but not after an abbreviation's points (three at most)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"(?iu)(?<=[.!?…。！？])(?<!(?:^|\\s)(?:{_SHORT})\\.{{1,3}})\\s+(?=\\S)"), lambda s: F.btrim(s) != "")


def ngrams(words: Column, n: int) -> Column:
    """Distinct n-grams as 64-bit hashes of their words; none if there are fewer than ``n`` words."""
    gram = lambda h, i: F.xxhash64(*[F.get(h, i + k) for k in range(n)])
    made = lambda h: F.when(F.size(h) >= n, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: gram(h, i)))).otherwise(F.array().cast("array<bigint>"))
    return let(F.transform(words, lambda w: F.xxhash64(w)), made)


def mixed_script(text: Column) -> Column:
    """Tokens that mix Cyrillic and Latin letters in one run; a hyphen ends a run."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\\p{L}+"), F.lit(0))
    return F.filter(runs, lambda w: w.rlike(CYRILLIC) & w.rlike(LATIN))


def strip_tags(html: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " "), "<[^>]*>", " "))


def isbn_valid(text: Column) -> Column:
    """ISBN-10 and ISBN-13 check digits."""
    d = F.regexp_replace(F.upper(text), "[^0-9X]", "")
    digit = lambda i: F.when(F.substring(d, i, 1) == "X", 10).otherwise(F.substring(d, i, 1).try_cast("int"))
    ten = sum((digit(i) * (11 - i) for i in range(1, 11)), F.lit(0)) % 11 == 0
    thirteen = sum((digit(i) * (1 if i % 2 else 3) for i in range(1, 14)), F.lit(0)) % 10 == 0
    return F.coalesce(F.when(F.length(d) == 10, ten & ~F.substring(d, 1, 9).contains("X")).when(F.length(d) == 13, thirteen & ~d.contains("X")), F.lit(False))


def doi_valid(text: Column) -> Column:
    return F.coalesce(text.rlike("^10\\.\\d{4,9}/\\S+$"), F.lit(False))


def content_hash(text: Column) -> Column:
    return F.sha2(F.btrim(F.regexp_replace(nfc(text), "\\s+", " ")), 256)


def property_slug(site: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(F.lower(site), "^(sc-domain:|https?://)", ""), "[^a-z0-9]+", "-"), F.lit("-"))
