"""The publishing hold: triggers set it, and only a whole release by a named person lifts it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.thresholds import GateFailure

#: The triggers of a hold.
TRIGGERS = ["K1", "K2", "K3", "K4", "K5", "K6"]
#: What a release must state; an unknown cause is stated as such.
STATED = ["released_by", "evidence", "cause", "remediation", "metric"]
#: Held projects that an error message lists.
SHOWN = 10


def is_whole(release: Column | None = None) -> Column:
    """Whether a release names its person, evidence, cause, remediation, metric, pages and date of the check."""
    field = lambda c: F.col(c) if release is None else release[c]
    said = [F.length(F.btrim(F.coalesce(field(c), F.lit("")))) > 0 for c in STATED]
    out = F.coalesce(F.size(field("urls")) > 0, F.lit(False)) & field("check_on").isNotNull()
    for one in said:
        out &= one
    return out


def holds(raised: DataFrame, releases: DataFrame) -> DataFrame:
    """One row for each project and trigger that was raised: when last, when released after that, and whether it holds.

    ``raised``: ``project``, ``trigger``, ``at``; ``releases``: the same and what
    :func:`is_whole` wants. Triggers that aren't known are refused by
    :func:`unknown_triggers`, not here. A release that isn't whole, or not later
    than the trigger, lifts nothing. One shuffle, combined before it.
    """
    key = ["project", "trigger"]
    none = F.lit(None).cast(raised.schema["at"].dataType)
    events = raised.select(*key, F.col("at").alias("_r"), none.alias("_f")).unionByName(releases.filter(is_whole()).select(*key, none.alias("_r"), F.col("at").alias("_f")))
    last = events.groupBy(*key).agg(F.max("_r").alias("raised_at"), F.max("_f").alias("_f")).filter("raised_at is not null")
    lifted = F.when(F.col("_f") > F.col("raised_at"), F.col("_f"))
    return last.select(*key, "raised_at", lifted.alias("released_at"), lifted.isNull().alias("held"))


def unknown_triggers(raised: DataFrame) -> DataFrame:
    return raised.filter(~F.coalesce(F.col("trigger").isin(TRIGGERS), F.lit(False)))


def require_release(state: DataFrame) -> None:
    """An error while any project is held: nothing is published, approved items included."""
    found = state.filter("held").select("project", "trigger").limit(SHOWN).collect()
    if found:
        raise GateFailure("publishing is held: " + "; ".join(f"{row['project']} {row['trigger']}" for row in found))
