"""From telemetry tables to findings, scores and fleet comparison, over any number of runs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame

from ..functions.session import written
from ..operators import anomalies, apps, compare, derive, events, gpu, latency, network, offenders, scores, slowdowns, trends
from ..operators.series import dense_index, percentile_linear
from ..thresholds import Thresholds


class Analysis:
    """Lazy findings over the tables of many runs.

    ``tables`` holds ``runs``, ``system``, ``process``, ``latency`` and optionally
    ``connections``, ``process_events``, ``gpu_engine``, ``gpu_process``, ``gpu_adapter``,
    ``event_log``, ``antivirus`` and ``trend_process`` (the process rows for trends, if not
    ``process``). ``limits`` is used for every family that has no own entry in ``own``.
    """

    def __init__(self, tables: dict[str, DataFrame], limits=Thresholds(), **own):
        self.tables = tables
        self.limits = limits
        self.own = own
        self._kept: dict[str, DataFrame] = {}

    def _th(self, family: str):
        return self.own.get(family, self.limits)

    def __getitem__(self, table: str) -> DataFrame:
        return self.tables[table]

    def kept(self, name: str) -> DataFrame:
        """A finding written once (it is small) for the steps that read it several times."""
        if name not in self._kept:
            self._kept[name] = written(getattr(self, name))
        return self._kept[name]

    @cached_property
    def indexed_system(self) -> DataFrame:
        return dense_index(self["system"])

    @cached_property
    def anomalies(self) -> DataFrame:
        return anomalies.detect_anomalies(self.indexed_system, self["latency"], self._th("anomaly"))

    @cached_property
    def windows(self) -> DataFrame:
        return slowdowns.slowdown_windows(self.indexed_system, self._th("slowdown"))

    @cached_property
    def hits(self) -> DataFrame:
        return slowdowns.slowdown_latency_hits(self.kept("windows"), self["latency"], self._th("slowdown"))

    @cached_property
    def suspects(self) -> DataFrame:
        return slowdowns.slowdown_offenders(self.kept("windows"), self["process"])

    @cached_property
    def slowdowns(self) -> DataFrame:
        return slowdowns.slowdown_confidence(self.kept("windows"), self.hits, self._th("slowdown"))

    @cached_property
    def described_slowdowns(self) -> DataFrame:
        named = slowdowns.suspect_names(self.kept("suspects"))
        return slowdowns.slowdown_confidence(self.kept("windows"), self.hits, self._th("slowdown"), named)

    @cached_property
    def trends(self) -> DataFrame:
        return trends.trend_stats(self.tables.get("trend_process", self.tables.get("process")), th=self._th("leak"))

    @cached_property
    def leaks(self) -> DataFrame:
        return trends.detect_leaks(self["process"], self._th("leak"), self.kept("trends"))

    @cached_property
    def pids(self) -> DataFrame:
        return offenders.per_pid_aggregates(self["process"])

    @cached_property
    def offenders(self) -> DataFrame:
        return offenders.rank_offenders(self.kept("pids"))

    @cached_property
    def security(self) -> DataFrame:
        return offenders.security_offenders(self.kept("pids"))

    @cached_property
    def background(self) -> DataFrame:
        return offenders.background_offenders(self.kept("pids"))

    @cached_property
    def apps(self) -> DataFrame:
        return apps.rank_apps(apps.app_aggregates(self["process"]))

    @cached_property
    def churn(self) -> DataFrame:
        return offenders.process_churn(self["process_events"])

    @cached_property
    def spawners(self) -> DataFrame:
        return offenders.top_spawners(self["process_events"])

    @cached_property
    def targets(self) -> DataFrame:
        return latency.latency_by_target(self["latency"])

    @cached_property
    def dns(self) -> DataFrame:
        return latency.dns_findings(self.targets, self._th("latency"))

    @cached_property
    def gpu_engines(self) -> DataFrame:
        return gpu.gpu_engine_stats(self["gpu_engine"])

    @cached_property
    def gpu_pids(self) -> DataFrame:
        return gpu.gpu_process_memory(self["gpu_process"], gpu.first_process_names(self["process"]))

    @cached_property
    def correlated(self) -> DataFrame:
        return events.correlate_events(self["event_log"], self.kept("slowdowns"), self._th("slowdown"))

    @cached_property
    def latency_p95(self) -> DataFrame:
        return percentile_linear(self["latency"], "avg_ms", 0.95, name="p95_ms")

    @cached_property
    def bottleneck_points(self) -> DataFrame:
        return scores.bottleneck_scores(
            self["system"], self.kept("anomalies"), self["latency"], self.kept("slowdowns"), self.kept("suspects")
        )

    @cached_property
    def bottleneck_reasons(self) -> DataFrame:
        return scores.bottleneck_reasons(
            self["system"], self.kept("anomalies"), self["latency"], self.kept("slowdowns"), self.kept("suspects")
        )

    @cached_property
    def bottlenecks(self) -> DataFrame:
        return scores.classify_bottleneck(self.bottleneck_points)

    @cached_property
    def scores(self) -> DataFrame:
        return scores.run_scores(*self._scored)

    @cached_property
    def score_inputs(self) -> DataFrame:
        return scores.score_inputs(*self._scored)

    @property
    def _scored(self) -> tuple[DataFrame, ...]:
        found = (self.kept("anomalies"), self.kept("slowdowns"), self.kept("leaks"))
        return (self["runs"], self.indexed_system, self["latency"], *found, self.offenders, self.security, self.background, self.kept("latency_p95"))

    @cached_property
    def verdicts(self) -> DataFrame:
        return scores.run_verdict(
            self.kept("scores"), self.kept("bottlenecks"), self.kept("anomalies"), self.kept("slowdowns"), self.kept("leaks")
        )

    @cached_property
    def recommendations(self) -> DataFrame:
        return scores.recommendations(
            self.kept("bottlenecks"), self.security, self.background, self.kept("leaks"),
            self.churn if "process_events" in self.tables else None, self.tables.get("antivirus"),
        )

    @cached_property
    def matrix(self) -> DataFrame:
        return compare.comparison_matrix(
            self["runs"], self.kept("scores"), self.kept("bottlenecks"), self.indexed_system, self["latency"],
            self.kept("anomalies"), self.kept("slowdowns"), self.kept("leaks"),
            self.churn if "process_events" in self.tables else None, self.kept("latency_p95"),
        )

    @cached_property
    def rankings(self) -> DataFrame:
        return compare.comparison_rankings(self.kept("matrix"))

    @cached_property
    def problems(self) -> DataFrame:
        return compare.common_and_unique_problems(self["runs"], self.kept("anomalies"), self.kept("slowdowns"))

    @cached_property
    def run_summary(self) -> DataFrame:
        return compare.run_summary(self["runs"], self.verdicts, self.kept("scores"), self.kept("bottlenecks"))

    def findings(self) -> dict[str, DataFrame]:
        """Every finding family for which there are tables."""
        out = {
            "anomalies": self.kept("anomalies"),
            "slowdowns": self.described_slowdowns,
            "slowdown_offenders": self.kept("suspects"),
            "leaks": trends.rank_leaks(self.kept("leaks")),
            "offenders": self.offenders.unionByName(self.security).unionByName(self.background),
            "apps": self.apps,
            "latency": self.targets,
            "dns": self.dns,
            "bottlenecks": self.kept("bottlenecks"),
            "bottleneck_reasons": self.bottleneck_reasons,
            "summary": self.verdicts,
            "recommendations": self.recommendations,
        }
        t = self.tables
        if "connections" in t:
            out["connections_by_pid"] = network.connections_by_pid(t["connections"])
            out["connections_by_app"] = network.connections_by_app(t["connections"])
            out["top_remotes"] = network.top_remotes(t["connections"], "app_key")
            out["connection_status"] = network.connection_status_counts(t["connections"], "app_key")
        if "process_events" in t:
            out |= {"churn": self.churn, "spawners": self.spawners}
        if "gpu_engine" in t:
            out |= {"gpu_engines": self.gpu_engines, "gpu_findings": gpu.gpu_findings(self.gpu_engines, self._th("gpu"))}
        if "gpu_process" in t:
            out |= {"gpu_processes": self.gpu_pids, "gpu_apps": gpu.gpu_app_memory(self.gpu_pids)}
        if "gpu_adapter" in t:
            out["gpu_adapters"] = gpu.gpu_adapter_stats(t["gpu_adapter"])
        if "event_log" in t:
            out |= {"events": self.correlated, "event_buckets": events.event_bucket_counts(self.correlated),
                    "top_events": events.top_events(self.correlated)}
        if "disk_io_events" in t:
            out |= {"disk_io": derive.disk_io_by_process(t["disk_io_events"]), "disk_io_totals": derive.disk_io_totals(t["disk_io_events"])}
        return out
