"""Writers for the tables and text files a comparison leaves behind."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Decimals of reports and of metric files.
REPORT_DECIMALS = 3
METRIC_DECIMALS = 6
REPORT_COLUMNS = (
    "auroc",
    "auprc",
    "f1",
    "precision",
    "recall",
    "specificity",
    "prec_at_r95",
    "rec_at_p90",
)


def write_csv(frame: DataFrame, path: str, decimals: int | None = None, mode: str = "overwrite") -> None:
    """CSV with a header; ``decimals`` fixes the digits of all doubles."""
    if decimals is not None:
        frame = frame.select(
            *[
                _fixed(F.col(f"`{f.name}`"), decimals).alias(f.name)
                if isinstance(f.dataType, (T.DoubleType, T.FloatType))
                else F.col(f"`{f.name}`")
                for f in frame.schema
            ]
        )
    frame.write.mode(mode).csv(path, header=True)


def write_predictions(scored: DataFrame, path: str, threshold: float = 0.5, mode: str = "overwrite") -> None:
    """Positional predictions as ``tables.read_predictions`` reads them: six decimals, call at 0.5."""
    rows = scored.select("index", "label", "prob", (F.col("prob") >= threshold).cast("int").alias("pred_0.5"))
    write_csv(rows, path, METRIC_DECIMALS, mode)


def write_bed(windows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Windows as tab-separated chrom, start, end, key without a header."""
    windows.select("chrom", "start", "end", "key").write.mode(mode).csv(path, sep="\t")


def _fixed(column: Column, decimals: int) -> Column:
    return F.when(column.isNotNull() & ~F.isnan(column), F.format_string(f"%.{decimals}f", column))


def metric_lines(row: DataFrame, names: Mapping[str, str], decimals: int = METRIC_DECIMALS) -> DataFrame:
    """``NAME=value`` lines from a frame of metrics; ``names`` maps columns to names."""
    types = {f.name: f.dataType for f in row.schema}
    lines = []
    for column, name in names.items():
        value = F.col(column)
        text = _fixed(value, decimals) if isinstance(types[column], T.DoubleType) else value.cast("string")
        lines.append(F.concat_ws("=", F.lit(name), F.coalesce(text, F.lit("nan"))))
    return row.select(F.explode(F.array(*lines)).alias("value"))


def write_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    lines.write.mode(mode).text(path)


def write_loci(loci: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The loci list of the worst errors, one ``chrom:pos-pos`` per line."""
    loci.select(F.col("locus").alias("value")).write.mode(mode).text(path)


def report_rows(
    metrics: DataFrame, columns: Sequence[str] = REPORT_COLUMNS, decimals: int = REPORT_DECIMALS
) -> DataFrame:
    """One table line per tool: ``tool, line`` with fixed decimals, missing values empty."""
    cells = [F.coalesce(_fixed(F.col(c).cast("double"), decimals), F.lit("")) for c in columns]
    return metrics.select("tool", F.concat_ws(" | ", F.col("tool"), *cells).alias("line"))
