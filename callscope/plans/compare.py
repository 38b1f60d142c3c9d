"""The comparison of several tools on one truth: from raw tables to every report table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callscope.functions.keys import variant_key
from callscope.operators import curves, distribution, errors, metrics, overlap, resample, scores, strata
from callscope.operators.align import align_universe
from callscope.session import durable
from callscope.sources import sinks
from callscope.sources.columns import SYNONYMS, resolve_columns


def keyed_scores(frame: DataFrame, chain: str | Sequence[str] = "default") -> DataFrame:
    """A caller table with ``key`` and ``prob`` added where they are missing."""
    rows = frame
    if "key" not in rows.columns:
        parts = resolve_columns(frame, SYNONYMS, keep_rest=True)
        rows = parts.withColumn("key", variant_key())
    return rows if "prob" in rows.columns and chain == "default" else scores.caller_score(rows, chain)


@dataclass
class Comparison:
    """Scored calls of several tools and the tables derived from them.

    ``scored`` should be durable (a checkpoint or a written table): every report reads it.
    """

    scored: DataFrame
    tools: Sequence[str]
    annotations: DataFrame | None = None
    _points: DataFrame | None = field(default=None, repr=False)
    _replicates: dict[int, DataFrame] = field(default_factory=dict, repr=False)

    @classmethod
    def from_tables(
        cls,
        truth: DataFrame,
        callers: Mapping[str, DataFrame],
        chains: Mapping[str, str | Sequence[str]] | None = None,
        durable_scores: bool = True,
        pick: str = "max",
    ) -> Comparison:
        """Key, score and align the raw table of every tool; collect depth annotations on the way.

        Several calls of a tool on one key give their maximum, or with ``pick="first"`` the first
        row of the table; the first row also annotates the key. Rows are numbered as they are read.
        """
        chains = chains or {}
        calls, notes = None, []
        for tool, frame in callers.items():
            rows = keyed_scores(frame.withColumn("_row", F.monotonically_increasing_id()), chains.get(tool, "default"))
            note = scores.annotation(rows, ["_row"])
            if note is not None:
                notes.append(note)
            mine = rows.select(F.lit(tool).alias("tool"), "key", "prob", "_row")
            calls = mine if calls is None else calls.unionByName(mine)
        scored = align_universe(truth, calls, list(callers), pick, "_row")
        annotations = strata.consolidate_annotations(notes, ["_row"]) if notes else None
        return cls(durable(scored) if durable_scores else scored, list(callers), annotations)

    @property
    def points(self) -> DataFrame:
        """The curve of every tool: the one expensive table behind most reports."""
        if self._points is None:
            self._points = durable(curves.scored_curve(self.scored))
        return self._points

    def metrics(self) -> DataFrame:
        return metrics.metrics_from_curve(self.points)

    def roc(self) -> DataFrame:
        return curves.roc_points(self.points)

    def precision_recall(self) -> DataFrame:
        return curves.pr_points(self.points)

    def operating_points(self, rule: str = "aligned") -> DataFrame:
        return curves.operating_points(self.points, rule=rule)

    def confusion(self) -> DataFrame:
        return metrics.confusion_normalised(self.scored)

    def calibration(self) -> DataFrame:
        return distribution.calibration(self.scored, cut=durable)

    def brier(self) -> DataFrame:
        return metrics.brier(self.scored)

    def distributions(self) -> DataFrame:
        return distribution.score_summary(self.scored, cut=durable)

    def overlap(self) -> DataFrame:
        if len(self.tools) == 3:
            return overlap.overlap_counts(self.scored, self.tools)
        return overlap.overlap_regions(self.scored, self.tools)

    def replicates(self, reps: int = resample.BOOTSTRAP_REPS) -> DataFrame:
        """Areas of all tools on every resample; intervals and differences read the same table."""
        if reps not in self._replicates:
            values = resample.replicate_areas(self.scored, ["tool"], reps, resample.BOOTSTRAP_SEED)
            self._replicates[reps] = durable(values)
        return self._replicates[reps]

    def intervals(self, reps: int = resample.BOOTSTRAP_REPS) -> DataFrame:
        return resample.intervals(self.replicates(reps))

    def deltas(self, against: str | None = None, reps: int = resample.BOOTSTRAP_REPS) -> DataFrame:
        """Paired bootstrap of the first tool (or ``against``) with every other one."""
        first = against or self.tools[0]
        return resample.deltas(self.replicates(reps), first, [tool for tool in self.tools if tool != first])

    def sweep(self) -> DataFrame:
        return curves.threshold_sweep(self.scored, cut=durable)

    def strata(self) -> DataFrame | None:
        if self.annotations is None:
            return None
        return strata.stratified_areas(self.scored, self.annotations, cut=durable)

    def top_errors(self, n: int = 20) -> DataFrame:
        return errors.top_errors(self.scored, n)

    def write(self, folder: str, reps: int = resample.BOOTSTRAP_REPS) -> None:
        """All report tables under one folder."""
        table = self.metrics()
        sinks.write_csv(table, f"{folder}/performance_metrics", decimals=4)
        sinks.write_lines(
            sinks.report_rows(table).select(F.col("line").alias("value")), f"{folder}/performance_table"
        )
        sinks.write_csv(self.operating_points(), f"{folder}/operating_points", decimals=6)
        sinks.write_csv(self.roc(), f"{folder}/roc")
        sinks.write_csv(self.precision_recall(), f"{folder}/precision_recall")
        sinks.write_csv(self.confusion(), f"{folder}/confusion")
        sinks.write_csv(self.calibration(), f"{folder}/calibration")
        sinks.write_csv(self.distributions(), f"{folder}/score_distributions")
        sinks.write_csv(self.overlap(), f"{folder}/overlap_counts")
        sinks.write_csv(self.brier(), f"{folder}/brier")
        sweep = durable(self.sweep())
        sinks.write_csv(sweep.orderBy("tool", "threshold"), f"{folder}/threshold_sweep")
        sinks.write_csv(curves.best_thresholds(sweep), f"{folder}/best_thresholds")
        sinks.write_csv(self.intervals(reps), f"{folder}/area_intervals")
        if len(self.tools) > 1:
            sinks.write_csv(self.deltas(reps=reps), f"{folder}/delta_metrics_bootstrap")
        stratified = self.strata()
        if stratified is not None:
            sinks.write_csv(stratified, f"{folder}/stratified")
            points = strata.stratified_pr_points(self.scored, self.annotations, cut=durable)
            sinks.write_csv(points, f"{folder}/stratified_precision_recall")
        worst = self.top_errors()
        sinks.write_csv(worst, f"{folder}/top_errors_by_tool")
        sinks.write_loci(errors.loci(worst), f"{folder}/top_error_loci")
