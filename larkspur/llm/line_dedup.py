"""Line dedup over levelled sorted runs of line hashes.

The index is a small log-structured merge tree kept as Parquet tables in the
shared folder. A run holds, sorted by key, the number of documents of one or
more batches that have a line. A new batch is counted, anti-joined by merge
with the keys that the older runs have already settled as common, and the rest
is added as a run of level 0. When a level has ``fanout`` runs they are merged
to one run of the next level, so n batches leave O(log n) runs to read.

Keys are two 64-bit hashes of the normalised line, so that the text of a line
is never shuffled to count it. Only SQL functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE_CHARS, ascii_lower, discard, let, new_path, own_name, written

KEY = ["_k1", "_k2"]
#: Common lines, of 16 bytes each, up to which their keys are sent to every task; more are joined by merge.
BROADCAST_KEYS = 1_000_000


def line_key(line: Column) -> Column:
    """A line stripped of white space at both ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE_CHARS)))


class LineRuns:
    """Levelled sorted runs of (key hashes, number of documents)."""

    def __init__(self, spark: SparkSession, min_docs: int, fanout: int = 4):
        self.spark, self.min_docs, self.fanout = spark, min_docs, fanout
        self.levels: list[list[DataFrame]] = []

    def all_runs(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        if not runs:
            return None
        out = runs[0]
        for run in runs[1:]:
            out = out.unionByName(run)
        return out

    def common(self) -> DataFrame | None:
        """Keys that ``min_docs`` documents or more have, over all runs."""
        runs = self.all_runs()
        if runs is None:
            return None
        return runs.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs")).filter(F.col("n_docs") >= self.min_docs).select(*KEY)

    def add(self, lines: DataFrame) -> None:
        """Add a batch: one row for each document and distinct key."""
        counted = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"))
        settled = self.common()
        if settled is not None:
            counted = counted.join(settled.hint("merge"), KEY, "left_anti")
        self._put(0, counted)

    def _put(self, level: int, rows: DataFrame) -> None:
        run = written(rows.sortWithinPartitions(*KEY), f"line-run-{level}")
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            old, self.levels[level] = self.levels[level], []
            merged = old[0]
            for other in old[1:]:
                merged = merged.unionByName(other)
            self._put(level + 1, merged.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs")))
            discard(*old)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = 4, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove lines that many documents share, wherever they stand.

    A line counts once for a document however often it has it. Lines whose key
    is shorter than ``min_chars`` are never dropped. Null text is handled, and
    returned, as empty text (one empty line). Rows that repeat an id and a text
    count as one document and all get the same result; a null id is an id like
    any other. An empty table gives an empty table. A very long text is one row
    while it is split and put together again. Returns the input columns with the
    remaining text, plus ``n_lines`` and ``n_dropped`` (which replace input
    columns of these names; no other name can clash).
    """
    spark = docs.sparkSession
    cols = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    whole = F.coalesce(F.col(text_col), F.lit(""))
    row_id = [F.xxhash64(F.lit(1), F.col(id_col)).alias("_r1"), F.xxhash64(F.lit(2), whole).alias("_r2")]

    keyed = docs.select(*row_id, F.posexplode(F.split(whole, "\n", -1)).alias("_pos", "_line")).select("_r1", "_r2", "_pos", line_key(F.col("_line")).alias("_key"))
    keyed = keyed.filter(F.length("_key") >= min_chars)
    keyed = keyed.select("_r1", "_r2", "_pos", F.xxhash64("_key").alias("_k1"), F.xxhash64(F.lit(7), F.col("_key")).alias("_k2"), F.pmod(F.col("_r1"), F.lit(batches)).cast("int").alias("_batch"))
    path = new_path(spark, "lines")
    keyed.write.partitionBy("_batch").parquet(path)
    lines = spark.read.schema(keyed.schema).parquet(path)

    index = LineRuns(spark, min_docs, fanout)
    for batch in range(batches):
        index.add(lines.filter(F.col("_batch") == batch).select("_r1", *KEY).distinct())
    common = written(index.common(), "common-lines")

    common = F.broadcast(common) if common.count() <= BROADCAST_KEYS else common.hint("merge")
    dropped = lines.join(common, KEY, "left_semi").select("_r1", "_r2", "_pos").distinct()
    r1, r2, gone_col = (own_name(docs, c) for c in ("_r1", "_r2", "_gone"))
    dropped = dropped.groupBy(F.col("_r1").alias(r1), F.col("_r2").alias(r2)).agg(F.sort_array(F.collect_list("_pos")).alias(gone_col))
    gone = F.coalesce(F.col(gone_col), F.array().cast("array<int>"))
    joined = docs.select(*cols, row_id[0].alias(r1), row_id[1].alias(r2)).join(dropped, [r1, r2], "left")

    def rest(split: Column) -> Column:
        # The stretches between dropped lines; `gone` is sorted.
        start = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get(F.col(gone_col), k - 1) + 1)
        stop = lambda k: F.coalesce(F.get(F.col(gone_col), k), F.size(split))
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone_col)), lambda k: F.slice(split, start(k) + 1, stop(k) - start(k)))), "\n")

    kept = F.when(F.col(gone_col).isNull(), whole).otherwise(let(F.split(whole, "\n", -1), rest))
    n_lines = F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1
    return joined.select(*[kept.alias(text_col) if c == text_col else F.col(c) for c in cols], n_lines.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))
