"""Thresholds with provenance: a project's own value goes over the rule book's, and every value that is read is recorded."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The rule book's defaults.
DEFAULTS: dict[str, Any] = {
    "measurement.trim_days": 4,
    "striking.min_impressions": 20,
    "striking.position_min": 5.0,
    "striking.position_max": 20.0,
    "striking.max_ctr": None,
    "striking.result_cap": 50,
    "ctr_outliers.min_impressions": 50,
    "ctr_outliers.ratio": 0.5,
    "ctr_outliers.max_position": 10.0,
    "decay.min_prior_clicks": 50,
    "decay.drop": -0.25,
    "decay.cluster_margin": 0.15,
    "decay.min_cluster_pages": 3,
    "rising.min_clicks_now": 25,
    "rising.min_delta_clicks": 25,
    "rising.min_impressions": 30,
    "mismatch.min_impressions": 30,
    "lost.min_prior_impressions": 100,
    "lost.drop": -0.80,
    "gaps.min_impressions": 30,
    "gaps.min_best_position": 20.0,
    "seasonality.min_history_weeks": 52,
    "seasonality.residual_drop": -0.30,
    "seasonality.min_impressions": 100,
    "segmentation.require_brand_tokens": True,
    "ctr.prior_curve": "first_page_sage",
    "ctr.aio_multiplier": 0.39,
    "ctr.provisional_below_w": 0.30,
    "mode.steady_state_after_days": 90,
    "cannibalization.min_urls": 2,
    "cannibalization.min_clicks_second_url": 3,
    "cannibalization.min_impressions_per_pair": 10,
    "cannibalization.flip_rate": 0.30,
    "cannibalization.cosine_merge": 0.90,
    "cannibalization.detect_window_days": 28,
    "cannibalization.trim_days": 4,
    "cannibalization.leader_dominance": 0.80,
    "clustering.overlap_threshold": 3,
    "clustering.serp_depth": 10,
    "clustering.max_size": 20,
    "clustering.max_drift": 0.10,
}


class GateFailure(Exception):
    """A blocking finding; the report is written before this is raised."""


class Thresholds:
    """Local values over defaults. ``get`` records what was read; ``used`` is the record since the last ``reset``."""

    def __init__(self, local: Mapping[str, Any] | None = None, defaults: Mapping[str, Any] = DEFAULTS):
        self.local, self.defaults = flatten(local or {}), defaults
        self._used: dict[str, dict[str, Any]] = {}

    def get(self, key: str, *fallback: Any, note: str | None = None) -> Any:
        if key in self.local:
            value, source = self.local[key], "local"
        elif key in self.defaults:
            value, source = self.defaults[key], "doctrine"
        elif fallback:
            value, source = fallback[0], "fallback"
        else:
            raise KeyError(f"no threshold {key}, and no fallback")
        self._used[key] = {"key": key, "value": value, "source": source, "note": note}
        return value

    def calibrated(self, key: str) -> bool:
        return key in self.local

    def reset(self) -> None:
        self._used.clear()

    def used(self) -> list[dict[str, Any]]:
        return [self._used[k] for k in sorted(self._used)]

    def used_column(self) -> Column:
        """The record as an array of structs, the same literal on every row."""
        text = lambda v: F.lit(None).cast("string") if v is None else F.lit(str(v))
        return F.array(*[F.struct(F.lit(u["key"]).alias("key"), text(u["value"]).alias("value"), F.lit(u["source"]).alias("source"), text(u["note"]).alias("note")) for u in self.used()])


def flatten(nested: Mapping[str, Any], prefix: str = "") -> dict[str, Any]:
    """Nested maps to dotted keys; a map with ``value`` stands for that value."""
    out: dict[str, Any] = {}
    for key, value in nested.items():
        if isinstance(value, Mapping) and "value" in value:
            out[prefix + str(key)] = value["value"]
        elif isinstance(value, Mapping):
            out |= flatten(value, f"{prefix}{key}.")
        else:
            out[prefix + str(key)] = value
    return out
