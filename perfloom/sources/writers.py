"""Write tables, findings and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.series import dense_index
from ..schemas import FILES, TIMELINES
from .folder_files import registered


def _flat(df: DataFrame) -> DataFrame:
    """CSV has no arrays: join them with ``;`` as in the run folders."""
    arrays = [c for c, t in df.dtypes if t.startswith("array")]
    return df.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ";") for c in arrays})


def timeline_files(df: DataFrame, kind: str, lines: int = 20_000) -> DataFrame:
    """A timeline (run_id, its columns, row_ord) as CSV files of at most ``lines`` lines: run_folder, file, text."""
    fields = [c for c in TIMELINES[kind] if c in df.columns]
    order = [c for c in ("rel_seconds", "row_ord") if c in df.columns]
    rows = dense_index(_flat(df).select("run_id", *dict.fromkeys([*fields, *order])), order=order)
    line = F.to_csv(F.struct(*fields), {"escape": "\""})  # quotes inside a value are doubled
    parts = rows.groupBy("run_id", F.floor(F.col("idx") / lines).alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))).alias("lines"))
    text = F.concat(F.lit(",".join(fields) + "\n"), F.array_join("lines.line", "\n"), F.lit("\n"))
    name = F.format_string(FILES[kind].removesuffix(".csv") + "_%06d.csv", F.col("part"))
    return parts.select(F.col("run_id").alias("run_folder"), name.alias("file"), text.alias("text"))


def array_files(df: DataFrame, stem: str, order: str, items: int = 10_000) -> DataFrame:
    """Rows of each run as JSON arrays of at most ``items`` entries: run_folder, file, text."""
    fields = [c for c in df.columns if c not in ("run_id", order)]
    rows = dense_index(df, order=(order,))
    parts = rows.groupBy("run_id", F.floor(F.col("idx") / items).alias("part")).agg(F.array_sort(F.collect_list(F.struct("idx", F.struct(*fields).alias("v")))).alias("items"))
    return parts.select(F.col("run_id").alias("run_folder"), F.format_string(f"{stem}_%06d.json", "part").alias("file"), F.to_json("items.v").alias("text"))


def write_run_folders(files: list[DataFrame], root: str) -> None:
    """Tables of run_folder, file and text as the files of run folders under ``root``."""
    for df in files:
        registered(df.sparkSession)
        df.select("run_folder", "file", "text").write.format("run_document").mode("append").save(root)


def write_tables(tables: dict[str, DataFrame], path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Timelines with their fixed columns (others are left out), partitioned by run.

    Rows are spread by (run, hour), so a long run is written by several tasks.
    """
    for name, df in tables.items():
        if name not in TIMELINES:
            continue
        fields = [c for c in TIMELINES[name] if c in df.columns]
        extra = ["row_ord"] if "row_ord" in df.columns else []
        out = df.select("run_id", *extra, *fields)
        out = out.repartition("run_id", F.floor(F.col("rel_seconds") / 3600))
        writer = (_flat(out) if fmt == "csv" else out).write.mode(mode).partitionBy("run_id")
        if fmt == "csv":
            writer = writer.option("header", True)
        writer.format(fmt).save(f"{path}/{name}")


def write_findings(findings: dict[str, DataFrame], scores: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON line per finding under ``findings/<family>/run_id=...`` and one scores line per run.

    A run can have any number of findings, so they are not nested into a single document.
    """
    for family, df in findings.items():
        df.write.mode(mode).partitionBy("run_id").json(f"{path}/findings/{family}")
    scores.write.mode(mode).json(f"{path}/scores")


def write_comparison(
    matrix: DataFrame, rankings: DataFrame, observations: DataFrame, problems: DataFrame, winners: DataFrame,
    path: str, mode: str = "overwrite",
) -> None:
    matrix.write.mode(mode).option("header", True).csv(f"{path}/matrix")
    for name, df in {"rankings": rankings, "observations": observations, "problems": problems}.items():
        df.write.mode(mode).json(f"{path}/findings/{name}")
    winners.write.mode(mode).json(f"{path}/winners")
