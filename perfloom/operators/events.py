"""Event-log entries: buckets and their correlation with slowdown windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.naming import event_bucket
from ..thresholds import Thresholds
from .series import time_range_join, top_k


def correlate_events(events: DataFrame, slowdowns: DataFrame, th: Thresholds = Thresholds()) -> DataFrame:
    """Each event with its bucket and the list of slowdown windows around it.

    ``slowdowns`` as from `describe_slowdowns`; ``row_ord`` identifies an event within its run.
    """
    d = events.withColumn("bucket", event_bucket("provider"))
    w = th.attach(slowdowns, "event_pad_seconds")
    pad = F.col("th_event_pad_seconds")
    w = w.select(
        "run_id", "start_rel", "end_rel",
        F.coalesce(F.try_element_at("reason_tags", F.lit(1)), F.lit("slowdown")).alias("kind"),
        F.greatest(F.lit(0.0), F.col("start_rel") - pad).alias("_lo"),
        (F.col("end_rel") + pad).alias("_hi"),
    )
    # Windows are disjoint, so only the few within the padding can hold one event.
    matches = (
        time_range_join(d.select("run_id", "row_ord", "rel_seconds"), w, "_lo", "_hi")
        .groupBy("run_id", "row_ord")
        .agg(F.array_sort(F.collect_list(F.struct("start_rel", "end_rel", "kind"))).alias("correlated_slowdowns"))
    )
    out = d.join(matches, ["run_id", "row_ord"], "left")
    return out.withColumn("n_correlated", F.greatest(F.size(F.coalesce("correlated_slowdowns", F.array())), F.lit(0)))


def event_bucket_counts(correlated: DataFrame) -> DataFrame:
    return correlated.groupBy("run_id", "bucket").agg(
        F.count(F.lit(1)).alias("events"),
        F.count(F.when(F.col("n_correlated") > 0, 1)).alias("correlated"),
    )


def top_events(correlated: DataFrame, n: int = 15) -> DataFrame:
    order = [
        F.asc(F.coalesce(F.col("level_code").cast("int"), F.lit(9))),
        F.asc(F.when(F.col("n_correlated") > 0, 0).otherwise(1)),
        F.asc("bucket"),
        F.desc(F.coalesce("rel_seconds", F.lit(0.0))),
        F.asc("row_ord"),
    ]
    return top_k(correlated, ["run_id"], order, n)
