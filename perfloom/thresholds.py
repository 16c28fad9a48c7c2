"""Detection limits: one set for a whole job, or one set per run.

Operators never read a limit directly. They call ``th.attach(df, "name", ...)`` and use the
``th_name`` columns it adds. For a plain :class:`Thresholds` these are literals (Catalyst folds
them); for :class:`RunThresholds` they come from the run table, so one job can honour the
overrides of every run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Thresholds:
    cpu_sustained_pct: float = 85.0
    cpu_sustained_seconds: int = 10
    cpu_single_core_pct: float = 95.0
    cpu_single_core_seconds: int = 10
    mem_used_pct_high: float = 85.0
    mem_used_pct_critical: float = 93.0
    mem_commit_growth_mb_per_min: float = 50.0
    disk_active_pct: float = 85.0
    disk_active_seconds: int = 8
    net_latency_ms_high: float = 200.0
    net_latency_ms_critical: float = 500.0
    handle_growth_per_min_suspicious: float = 50.0
    handle_growth_per_min_likely: float = 150.0
    thread_growth_per_min_suspicious: float = 10.0
    thread_growth_per_min_likely: float = 30.0
    leak_min_duration_seconds: int = 120
    leak_min_slope_bytes_per_sec: float = 50_000.0
    slowdown_merge_gap_seconds: int = 5
    slowdown_min_duration_seconds: int = 3

    # Limits without a manifest name; they take part in the same way.
    cpu_merge_gap: int = 3
    core_merge_gap: int = 3
    core_others_avg_below: float = 50.0
    mem_sustained_samples: int = 10
    mem_merge_gap: int = 5
    disk_merge_gap: int = 3
    disk_peak_high: float = 95.0
    swap_peak_report: float = 20.0
    swap_peak_medium: float = 40.0
    unreachable_loss_pct: float = 50.0
    spike_loss_pct: float = 5.0
    slowdown_swap_pct: float = 15.0
    slowdown_latency_pad_seconds: float = 10.0
    slowdown_likely_samples: int = 10
    slowdown_strong_samples: int = 20
    trend_min_points: int = 20
    leak_min_growth_bytes: float = 20.0 * 1024 * 1024
    handle_min_growth: float = 100.0
    handle_strong_end: float = 5000.0
    thread_min_growth: float = 20.0
    gpu_engine_medium_pct: float = 70.0
    gpu_engine_high_pct: float = 85.0
    slow_dns_ms: float = 100.0
    slow_dns_high_ms: float = 300.0
    dns_fail_share: float = 0.25
    event_pad_seconds: float = 15.0

    def attach(self, df: DataFrame, *names: str) -> DataFrame:
        return df.withColumns({f"th_{n}": F.lit(getattr(self, n)) for n in names})


# The fields a run manifest may override; anything else in it is ignored.
MANIFEST_FIELDS = (
    "cpu_sustained_pct", "cpu_sustained_seconds", "cpu_single_core_pct", "cpu_single_core_seconds",
    "mem_used_pct_high", "mem_used_pct_critical", "mem_commit_growth_mb_per_min", "disk_active_pct", "disk_active_seconds",
    "net_latency_ms_high", "net_latency_ms_critical", "handle_growth_per_min_suspicious", "handle_growth_per_min_likely",
    "thread_growth_per_min_suspicious", "thread_growth_per_min_likely", "leak_min_duration_seconds",
    "leak_min_slope_bytes_per_sec", "slowdown_merge_gap_seconds", "slowdown_min_duration_seconds",
)


@dataclass(frozen=True)
class RunThresholds:
    """Limits taken from a run table as read by ``read_runs`` (columns ``th_*`` per run)."""

    runs: DataFrame
    base: Thresholds = Thresholds()

    def attach(self, df: DataFrame, *names: str) -> DataFrame:
        own = [n for n in names if f"th_{n}" in self.runs.columns]
        out = self.base.attach(df, *[n for n in names if n not in own])
        if not own:
            return out
        per_run = self.runs.select("run_id", *[F.col(f"th_{n}").alias(f"_own_{n}") for n in own])
        out = out.join(per_run, "run_id", "left")
        return out.select(
            *[c for c in out.columns if not c.startswith("_own_")],
            *[
                F.coalesce(F.col(f"_own_{n}"), F.lit(getattr(self.base, n))).alias(f"th_{n}")
                for n in own
            ],
        )
