"""Comparison of runs across a fleet."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import zero_if_null
from .scores import WEIGHTS
from .series import dense_index, percentile_linear

# ranking -> (matrix column, highest first)
RANKINGS = {
    **{f"best_{m}": (m, True) for m in ("overall", *WEIGHTS)},
    "lowest_cpu_avg": ("cpu_avg", False),
    "lowest_latency_p95": ("latency_p95_ms", False),
    "fewest_anomalies": ("anomalies", False),
}
# metric -> smallest reported difference
DELTAS = {
    "overall": 5.0, "cpu_avg": 3.0, "mem_avg": 3.0, "disk_avg": 3.0, "latency_p95_ms": 20.0,
    "anomalies": 3.0, "slowdowns": 3.0,
}
WINNERS = {
    "best_overall": "best_overall", "best_stability": "most_stable", "best_efficiency": "best_efficiency",
    "lowest_cpu_avg": "lowest_cpu_avg", "lowest_latency_p95": "lowest_latency_p95", "fewest_anomalies": "fewest_anomalies",
}
MATRIX_COLUMNS = [
    "run_id", "hostname", "mode", "tags", "duration_s", "samples", "overall", *WEIGHTS, "primary",
    "cpu_avg", "cpu_p95", "mem_avg", "disk_avg", "latency_p95_ms",
    "anomalies", "slowdowns", "memory_leaks", "handle_leaks", "process_starts",
]


def comparison_matrix(
    runs: DataFrame, scores: DataFrame, bottlenecks: DataFrame, system: DataFrame, latency: DataFrame,
    anomalies: DataFrame, slowdowns: DataFrame, leaks: DataFrame, churn: DataFrame | None = None,
    latency_p95: DataFrame | None = None,
) -> DataFrame:
    """One row of 24 columns per run: aggregates of the fleet tables joined on ``run_id``.

    ``latency_p95``: run_id and p95_ms of the latency, if they are at hand.
    """
    loads = system.select("run_id", zero_if_null("cpu_total_pct").alias("cpu"), zero_if_null("mem_percent").alias("mem"),
                          zero_if_null("disk_active_pct_est").alias("disk"))
    means = loads.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("samples"),
        *[F.bround(F.avg(c), 1).alias(f"{c}_avg") for c in ("cpu", "mem", "disk")],
    )
    p95 = lambda df, col, name: percentile_linear(df, col, 0.95, ("run_id",), name).withColumn(name, F.bround(name, 1))
    counted = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    kind = lambda k: leaks.filter(F.col("kind") == k)
    parts = [
        scores.select("run_id", "overall", *WEIGHTS),
        bottlenecks.select("run_id", "primary"),
        means,
        p95(loads, "cpu", "cpu_p95"),
        p95(latency, "avg_ms", "latency_p95_ms") if latency_p95 is None else latency_p95.select("run_id", F.bround("p95_ms", 1).alias("latency_p95_ms")),
        counted(anomalies, "anomalies"),
        counted(slowdowns, "slowdowns"),
        counted(kind("memory_leak_candidate"), "memory_leaks"),
        counted(kind("handle_leak_candidate"), "handle_leaks"),
    ]
    if churn is not None:
        parts.append(churn.select("run_id", F.col("total_process_starts").alias("process_starts")))
    about = runs.select(*[c for c in ("run_id", "hostname", "mode", "tags", "duration_s") if c in runs.columns])
    d = reduce(lambda a, b: a.join(b, "run_id", "left"), parts, about)
    counts = ["anomalies", "slowdowns", "memory_leaks", "handle_leaks", "process_starts", "samples"]
    if churn is None:
        d = d.withColumn("process_starts", F.lit(0).cast("bigint"))
    d = d.fillna(0, counts)
    defaults = {"tags": F.lit(""), "duration_s": F.lit(None).cast("double")}
    d = d.withColumns({n: e for n, e in defaults.items() if n not in runs.columns})
    if dict(d.dtypes)["tags"].startswith("array"):
        d = d.withColumn("tags", F.array_join("tags", ","))
    return d.select(*MATRIX_COLUMNS)


def comparison_rankings(matrix: DataFrame) -> DataFrame:
    """Ten rankings of all runs (null metrics left out), positions by a range sort."""
    entries = [
        F.when(
            F.col(col).isNotNull(),
            F.struct(
                F.lit(name).alias("ranking"), F.col(col).cast("double").alias("value"),
                (-F.col(col) if high else F.col(col)).cast("double").alias("_key"),
            ),
        )
        for name, (col, high) in RANKINGS.items()
    ]
    long = matrix.select("run_id", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("run_id", "e.*")
    d = dense_index(long, ("ranking",), ("_key", "run_id"))
    return d.select("ranking", (F.col("idx") + 1).alias("rank"), "run_id", "value")


def pairwise_observations(matrix: DataFrame, blocks: int = 16, pairs: DataFrame | None = None) -> DataFrame:
    """Metrics in which two runs differ noticeably, for each pair of runs.

    Without ``pairs`` all runs are compared with each other: they are spread over ``blocks`` groups, and a pair meets
    in the cell of its two groups, so the work is an equality join over ``blocks * (blocks + 1) / 2`` balanced cells.
    With ``pairs`` (run_a, run_b; as from `successive_runs`) only those are compared, in order as given: two joins by run,
    so work and rows grow with the pairs asked for. Pairs that are given twice count once; runs the matrix lacks
    have no observations.
    """
    rows = matrix.select("run_id", *[F.col(m).cast("double").alias(m) for m in DELTAS])
    met = _all_pairs(rows, blocks) if pairs is None else _asked_pairs(rows, pairs)
    found = []
    for m, least in DELTAS.items():
        delta = F.bround(F.col(f"a.{m}") - F.col(f"b.{m}"), 1)
        found.append(
            F.when(
                F.abs(delta) >= least,
                F.struct(F.lit(m).alias("metric"), F.col(f"a.{m}").alias("value_a"), F.col(f"b.{m}").alias("value_b"), delta.alias("delta")),
            )
        )
    return met.select(
        F.col("a.run_id").alias("run_a"), F.col("b.run_id").alias("run_b"),
        F.explode(F.array_compact(F.array(*found))).alias("o"),
    ).select("run_a", "run_b", "o.*")


def _all_pairs(rows: DataFrame, blocks: int) -> DataFrame:
    spread = rows.withColumn("_b", F.pmod(F.xxhash64("run_id"), F.lit(blocks)).cast("int")).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cell = [F.least("_b", "_other").alias("_lo"), F.greatest("_b", "_other").alias("_hi")]
    left = spread.select("run_id", "_b", *DELTAS, *cell).alias("a")
    right = spread.select("run_id", "_b", *DELTAS, *cell).alias("b")
    pairs = left.join(right, ["_lo", "_hi"]).filter(F.col("a.run_id") < F.col("b.run_id"))
    # In a cell of two groups each run must come from its own group.
    return pairs.filter((F.col("_lo") == F.col("_hi")) | (F.col("a._b") != F.col("b._b")))


def _asked_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    asked = pairs.select("run_a", "run_b").distinct()
    first = asked.join(rows.select("run_id", F.struct(*rows.columns).alias("a")), F.col("run_a") == F.col("run_id")).drop("run_id")
    return first.join(rows.select("run_id", F.struct(*rows.columns).alias("b")), F.col("run_b") == F.col("run_id")).drop("run_id")


def successive_runs(runs: DataFrame, host: str, order: str, back: int = 1) -> DataFrame:
    """run_a, run_b: each run of a host with the ``back`` runs before it, by ``order`` and then run_id.

    A run stands in at most ``back`` pairs as the later one, so pairs grow with runs. Positions come from one range
    sort, so a host of very many runs is no single task; runs without a host have none before them.
    """
    placed = dense_index(runs.select("run_id", F.col(host).alias("_host"), F.col(order).alias("_order")), ("_host",), ("_order", "run_id"))
    later = placed.select("_host", F.col("run_id").alias("run_b"), F.explode(F.sequence(F.col("idx") - back, F.col("idx") - 1)).alias("idx"))
    return later.join(placed.select("_host", "idx", F.col("run_id").alias("run_a")), ["_host", "idx"]).select("run_a", "run_b")


def problem_kinds(anomalies: DataFrame, slowdowns: DataFrame) -> DataFrame:
    kinds = anomalies.select("run_id", F.coalesce("kind", F.lit("?")).alias("problem"))
    tags = slowdowns.select("run_id", F.explode("reason_tags").alias("t")).select(
        "run_id", F.concat(F.lit("slowdown_"), "t").alias("problem")
    )
    return kinds.union(tags).distinct()


def common_and_unique_problems(runs: DataFrame, anomalies: DataFrame, slowdowns: DataFrame) -> DataFrame:
    """``common``: kinds every run has (run_id null); ``unique``: kinds only one run has."""
    kinds = problem_kinds(anomalies, slowdowns)
    n_runs = runs.agg(F.count(F.lit(1)).alias("n")).scalar()
    per_kind = kinds.groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("_only"))
    common = per_kind.filter(F.col("n") == n_runs).select(
        F.lit("common").alias("scope"), F.lit(None).cast("string").alias("run_id"), "problem"
    )
    unique = per_kind.filter("n = 1").select(F.lit("unique").alias("scope"), F.col("_only").alias("run_id"), "problem")
    return common.union(unique)


def comparison_winners(rankings: DataFrame) -> DataFrame:
    first = rankings.filter("rank = 1")
    return first.agg(
        *[F.max(F.when(F.col("ranking") == r, F.col("run_id"))).alias(name) for r, name in WINNERS.items()]
    )


def run_summary(runs: DataFrame, verdicts: DataFrame, scores: DataFrame, bottlenecks: DataFrame) -> DataFrame:
    d = runs.join(verdicts.select("run_id", "verdict"), "run_id", "left")
    d = d.join(scores.select("run_id", "overall", "confidence"), "run_id", "left")
    return d.join(bottlenecks, "run_id", "left")
