"""One query per operator over the benchmark tables; ``oracle.py`` holds the same in plain SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callscope.functions import keys, numeric, sequence
from callscope.operators import (
    align,
    curves,
    distribution,
    errors,
    features,
    learn,
    metrics,
    overlap,
    regions,
    resample,
    scores,
    strata,
    train,
)
from callscope.plans import views
from callscope.plans.views import TOOLS
from callscope.session import durable, shared_folder
from callscope.sources import batches, columns, fasta, sinks, tables, variants
from callscope.sources import reads as stored_reads
from callscope.sources.tables import load_truth

Query = Callable[[SparkSession, str], DataFrame]

BOOTSTRAP_REPS = resample.BOOTSTRAP_REPS
STRATIFIED_REPS = resample.STRATIFIED_REPS
SEED = 123
DIGITS = 6
SEQUENCE_STRIDE = 256
SEQUENCE_RADIUS = 10
WINDOW_RADIUS = 100
TRAIN_EPOCHS = 3
TRAIN_BATCHES = 2


def rounded(frame: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles at the very end, so that two engines agree on their last digits."""
    return frame.select(
        *[
            F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
            for f in frame.schema
        ]
    )


def on_scored(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(build(views.scored(spark, sf)))


def on_points(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: rounded(build(curves.scored_curve(views.scored(spark, sf), cut=durable)))


# --- keys and variants -------------------------------------------------------------------------


def normalize_key(spark, sf):
    raw = views.variants(spark, sf)
    return raw.select(
        keys.norm_chrom("chrom").alias("chrom"),
        keys.norm_pos(F.concat(F.col("pos").cast("string"), F.lit(".0"))).alias("pos"),
        keys.norm_allele("ref").alias("ref"),
        keys.norm_allele("alt").alias("alt"),
    )


def variant_key(spark, sf):
    return views.variants(spark, sf).select(keys.variant_key().alias("key"), "label")


def split_key(spark, sf):
    return views.variants(spark, sf).select(keys.variant_key().alias("key")).select(*keys.split_key())


def explode_alts(spark, sf):
    return views.variants(spark, sf).select("chrom", "pos", "ref", keys.split_alts().alias("alt"))


def site_windows(spark, sf):
    return regions.site_windows(views.variants(spark, sf), WINDOW_RADIUS)


def merge_label(spark, sf):
    raw = views.variants(spark, sf)
    return align.merge_labelled(raw.filter("label = 0"), raw.filter("label = 1"))


def truth_load(spark, sf):
    raw = views.variants(spark, sf).withColumnsRenamed(
        {"chrom": "Chromosome", "pos": "Start_Position", "ref": "Reference_Allele", "alt": "Tumor_Seq_Allele2",
         "label": "seqc2_positive"}
    )
    return load_truth(raw)


def first_per_key(spark, sf):
    raw = views.variants(spark, sf).select(keys.variant_key().alias("key"), "label", "src_rank")
    return align.first_per_key(raw, ["key"], ["src_rank", "label"]).select("key", "label")


# --- scores ------------------------------------------------------------------------------------


def coerce_clip(spark, sf):
    return views.calls_raw(spark, sf).select(
        "id", "rn", numeric.clip(numeric.to_number("tlod"), 1000.0, 50000.0).alias("clipped")
    )


def minmax_scale(spark, sf):
    return rounded(scores.minmax_scale(views.calls_raw(spark, sf).select("id", "rn", "tlod"), "tlod", "scaled"))


def allele_fraction(spark, sf):
    raw = views.calls_raw(spark, sf)
    return rounded(
        raw.select(
            "id",
            "rn",
            numeric.allele_fraction("t_ref_count", "t_alt_count").alias("vaf"),
            numeric.allele_depth("t_ref_count", "t_alt_count").alias("depth"),
        )
    )


def allele_fraction_ad(spark, sf):
    ref, alt = numeric.count_pair("ad")
    return rounded(
        views.calls_raw(spark, sf).select("id", "rn", numeric.allele_fraction(ref, alt).alias("vaf"))
    )


def qual_logistic(spark, sf):
    return rounded(views.calls_raw(spark, sf).select("id", "rn", numeric.logistic_quality("qual").alias("score")))


def score_chain(spark, sf):
    """Three tables with other columns each, so that each takes another link of the chain."""
    raw = views.calls_raw(spark, sf)
    parts = None
    for name, columns in (
        ("tlod", ["tlod", "t_ref_count", "t_alt_count", "qual"]),
        ("af", ["ad", "qual"]),
        ("qual", ["qual"]),
    ):
        part = scores.score_chain(raw.select("id", "rn", *columns), "tlod").select(
            F.lit(name).alias("link"), "id", "rn", "prob"
        )
        parts = part if parts is None else parts.unionByName(part)
    return rounded(parts)


def score_fallback(spark, sf):
    raw = views.calls_raw(spark, sf).select("id", "rn", "filter")
    return scores.caller_score(raw).select("id", "rn", "prob")


def info_score(spark, sf):
    lines = views.info_lines(spark, sf)
    return lines.select(
        "event_id",
        variants.info_score("info", "qual").alias("strict_score"),
        variants.info_score("info", "qual", strict=False).alias("loose_score"),
    )


def maf_scan(spark, sf):
    """Mutation tables of two column orders, with comments and a second genome build."""
    return variants.parse_maf(variants.without_comments(views.maf_lines(spark, sf)))


def truth_vcf_scan(spark, sf):
    return variants.parse_truth_vcf(variants.without_comments(views.truth_lines(spark, sf)))


def good_calls(spark, sf):
    return rounded(variants.good_calls(variants.parse_calls(views.call_lines(spark, sf))))


def fasta_chunks(spark, sf):
    """Lines of documents as sequences in files of several splits, put together again as chunks."""
    chunks = fasta.assemble_chunks(fasta.place_lines(views.fasta_lines(spark, sf)), SEQUENCE_STRIDE, 2 * SEQUENCE_RADIUS + 1)
    return chunks.select("contig", "chunk_id", "text")


def _linear(rows):
    """Given coefficients and the logistic function."""
    values = F.transform("embedding", lambda x, i: x.cast("double") * ((i * 37 % 11 - 5) / 10.0))
    total = F.aggregate(values, F.lit(0.0), lambda a, b: a + b)
    return rows.withColumn("prob", numeric.sigmoid(total))


def linear_scores(spark, sf):
    return rounded(_linear(views.table(spark, sf, "embeddings")).select("vec_id", "prob"))


def batch_scores(spark, sf):
    """Rows stored in order and scored batch by batch."""
    folder = f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    batches.write_ordered(views.table(spark, sf, "embeddings").select("vec_id", "embedding"), folder, ["vec_id"], 1000)
    scored = batches.score_batches(spark, folder, f"{folder}/scores", lambda rows: _linear(rows).drop("embedding"), 4)
    return rounded(scored.select("row", "vec_id", "prob"))


def quarantine(spark, sf):
    """Call lines built from the raw columns: those with something wrong are set aside."""
    bad = variants.bad_lines(variants.parse_calls(views.call_lines(spark, sf)))
    return bad.groupBy("reason", "line").agg(F.count(F.lit(1)).alias("n_rows"))


def annotations(spark, sf):
    """Events annotate first (fraction only), the counts of the raw calls second."""
    raw = views.calls_raw(spark, sf).withColumn("key", F.col("id").cast("string"))
    counted = scores.annotation(raw, ["rn"])
    events = views.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("key"),
        numeric.clip(F.col("value") / 1000.0, 0.0, 1.0).alias("vaf_est"),
        F.lit(None).cast("double").alias("depth_est"),
        F.lit(0).alias("rn"),
    )
    return rounded(strata.consolidate_annotations([events, counted], ["rn", "depth_est", "vaf_est"]))


# --- joins and sets ----------------------------------------------------------------------------


def align_universe(spark, sf):
    return views.scored(spark, sf)


def max_per_key(spark, sf):
    return align.max_per_key(views.calls(spark, sf), ["tool", "key"])


def clean_by_key(spark, sf):
    return align.clean_by_key(views.calls(spark, sf).select("key", "prob"), views.truth(spark, sf))


def label_calls(spark, sf):
    """Orders still in progress have no label, so some calls stay unlabelled."""
    settled = views.table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    known = settled.selectExpr("CAST(o_orderkey AS STRING) AS key", "CAST(o_orderstatus = 'F' AS INT) AS label")
    return align.label_calls(views.calls(spark, sf), known, ["prob"])


def paired_scores(spark, sf):
    return align.paired_scores(views.scored(spark, sf), "model", "caller_1")


def cyclic_zip(spark, sf):
    mapping = views.table(spark, sf, "part").select(F.col("p_partkey").alias("row"), "p_brand", "p_size")
    return align.cyclic_zip(views.positional(spark, sf), mapping, on_mismatch="cycle")


def drop_unlabelled(spark, sf):
    documents = views.table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    labels = views.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return align.drop_unlabelled(documents.join(labels, "doc_id", "left"))


def _signals(spark, sf):
    first = views.table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("key"), F.col("c_acctbal").alias("mean")
    )
    second = views.table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("key"), F.col("s_acctbal").alias("mean")
    )
    evidence = views.table(spark, sf, "part").select(
        (F.col("p_partkey") + 50).cast("string").alias("key"),
        F.col("p_size").cast("string").alias("DP"),
        F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("AD"),
        (F.col("p_size") / 100.0).alias("VAF"),
        F.col("p_retailprice").alias("MQ"),
        F.lit(None).cast("double").alias("SB"),
    )
    return features.merge_evidence(first, second, evidence)


def qc_merge(spark, sf):
    return rounded(_signals(spark, sf))


def _with_features(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("key"), "l_orderkey", "l_linenumber"
    )
    return features.feature_join(rows, _signals(spark, sf))


def feature_join(spark, sf):
    return rounded(_with_features(spark, sf))


def qc_vector(spark, sf):
    vectors = features.with_qc_vector(_with_features(spark, sf))
    return vectors.select(
        "l_orderkey",
        "l_linenumber",
        F.array_join(F.transform("qc", lambda x: F.floor(x * 100 + 0.5).cast("bigint").cast("string")), ",").alias("qc"),
    )


# --- regions and sequences ---------------------------------------------------------------------


def pileup_qc(spark, sf):
    evidence = regions.pileup(views.sites(spark, sf), views.reads(spark, sf), bin_width=64)
    return rounded(evidence)


def pileup_regions(spark, sf):
    """The same evidence from reads stored by region."""
    folder = f"{shared_folder(spark)}/reads-{uuid.uuid4().hex}"
    stored_reads.write_reads(views.reads(spark, sf), folder)
    places = views.sites(spark, sf)
    return rounded(regions.pileup(places, stored_reads.read_regions(spark, folder, places), bin_width=64))


def pileup_gaps(spark, sf):
    """Reads with deletions, qualities and flags."""
    return rounded(regions.pileup(views.sites(spark, sf), views.paired_reads(spark, sf), bin_width=64))


def pileup_mates(spark, sf):
    return rounded(regions.pileup(views.sites(spark, sf), views.paired_reads(spark, sf), bin_width=64, mates="once"))


def window_signal(spark, sf):
    windows = views.sites(spark, sf).select(
        "key",
        "chrom",
        F.greatest(F.col("pos") - 1 - WINDOW_RADIUS, F.lit(0)).cast("bigint").alias("start"),
        (F.col("pos") + WINDOW_RADIUS).cast("bigint").alias("end"),
    )
    return rounded(regions.window_signal(windows, views.signal(spark, sf)))


def _windows(spark, sf):
    chunks = fasta.chunk_text(views.contigs(spark, sf), SEQUENCE_STRIDE, 2 * SEQUENCE_RADIUS + 1)
    return features.sequence_windows(views.contig_sites(spark, sf), chunks, SEQUENCE_RADIUS, SEQUENCE_STRIDE)


def seq_window(spark, sf):
    return _windows(spark, sf).select("site", "contig", "pos", "seq")


def one_hot(spark, sf):
    channels = _windows(spark, sf).withColumn("channels", sequence.one_hot("seq"))

    def digits(i: int):
        return F.array_join(F.transform(F.col("channels")[i], lambda x: x.cast("string")), "")

    return channels.select(
        "site", *[digits(i).alias(f"channel_{base.lower()}") for i, base in enumerate(sequence.BASES)]
    )


def transpose_array(spark, sf):
    grid = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.get("embedding", i * 8 + j)),
    )
    turned = views.table(spark, sf, "embeddings").select("vec_id", sequence.transpose(grid, 8).alias("turned"))
    rows = turned.select("vec_id", F.posexplode("turned").alias("i", "line"))
    return rounded(
        rows.select("vec_id", "i", F.posexplode("line").alias("j", "x")).select(
            "vec_id", "i", "j", F.col("x").cast("double").alias("x")
        )
    )


# --- learning ----------------------------------------------------------------------------------


def lr_scores(spark, sf):
    rows = views.table(spark, sf, "embeddings").select(
        "vec_id", (F.col("label") % 2).cast("int").alias("label"), "embedding"
    )
    vectors = learn.with_class_weight(learn.vectorise(rows, ["embedding"]))
    split = resample.hash_split(vectors, "vec_id")
    model = learn.classifier("logistic").fit(split.filter("split = 'train'"))
    return rounded(learn.score(model, split.drop("embedding", "weight")))


def epoch_metrics(spark, sf):
    return rounded(train.history(spark, _fitted(spark, sf)))


@lru_cache(maxsize=8)
def _fitted(spark, sf):
    settings = train.Settings(epochs=TRAIN_EPOCHS, patience=TRAIN_EPOCHS, batches=TRAIN_BATCHES)
    return train.fit(views.training_rows(spark, sf), settings)


def epoch_scores(spark, sf):
    """All rows scored by the best epoch."""
    return rounded(train.score(views.training_rows(spark, sf), _fitted(spark, sf)))


# --- files written and read back -----------------------------------------------------------------


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def csv_scan(spark, sf):
    """A table with a header, its columns in another order."""
    folder = _folder(spark, "scored")
    sinks.write_csv(views.scored(spark, sf).select("tool", "prob", "key", "label"), folder)
    return rounded(tables.read_table(spark, folder, "key string, label int, prob double, tool string"))


def prediction_scan(spark, sf):
    folder = _folder(spark, "predictions")
    model = views.scored(spark, sf).filter("tool = 'model'")
    sinks.write_predictions(model.select(F.col("key").cast("bigint").alias("index"), "label", "prob"), folder)
    return tables.read_predictions(spark, folder)


def keyed_scan(spark, sf):
    """Keyed predictions in which some scores are no numbers."""
    folder = _folder(spark, "keyed")
    text = F.when(F.col("key").endswith("7"), "n/a").otherwise(F.format_string("%.6f", "prob"))
    sinks.write_csv(views.scored(spark, sf).filter("tool = 'model'").select("key", text.alias("prob")), folder)
    return tables.read_keyed_predictions(spark, folder)


def signal_scan(spark, sf):
    """Signals of windows as tab-separated lines without a header."""
    folder = _folder(spark, "signal")
    window_signal(spark, sf).write.csv(folder, sep="\t")
    return tables.read_signal(spark, folder)


def bed_lines(spark, sf):
    folder = _folder(spark, "windows")
    sinks.write_bed(site_windows(spark, sf), folder)
    return spark.read.text(folder)


def metric_lines(spark, sf):
    """Counts and ratios of one tool as NAME=value lines."""
    folder = _folder(spark, "metrics")
    row = metrics.threshold_metrics(views.scored(spark, sf)).filter("tool = 'model'")
    names = {"tp": "TP", "fp": "FP", "tn": "TN", "fn": "FN", "precision": "PRECISION", "recall": "RECALL"}
    sinks.write_lines(sinks.metric_lines(row, names), folder)
    return spark.read.text(folder)


def column_synonyms(spark, sf):
    """Columns under other names, some of them only contained in the name."""
    raw = views.variants(spark, sf).drop("src_rank").withColumnsRenamed(
        {"chrom": "#CHROM", "pos": "Start_Position (bp)", "ref": "Reference Allele", "alt": "my alt1 column", "label": "Y"}
    )
    return columns.resolve_columns(raw, {**columns.SYNONYMS, "label": columns.LABEL_SYNONYMS})


def second_chain(spark, sf):
    """The chain that ends in one half; a score that is the same everywhere falls back on the filter."""
    raw = views.calls_raw(spark, sf)
    quality = scores.caller_score(raw.drop("tlod"), "simple").select(F.lit("qual").alias("link"), "id", "rn", "prob")
    half = scores.caller_score(raw.select("id", "rn", "filter"), "simple").select(F.lit("half").alias("link"), "id", "rn", "prob")
    return rounded(quality.unionByName(half))


# --- strata ------------------------------------------------------------------------------------


def fixed_bins(spark, sf):
    noted = views.scored(spark, sf).join(views.depths(spark, sf), "key", "left")
    return (
        noted.withColumn("vaf_bin", numeric.fixed_bin("vaf_est"))
        .groupBy("tool", "vaf_bin")
        .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives"))
    )


def quantile_bins(spark, sf):
    noted = views.scored(spark, sf).join(views.depths(spark, sf), "key", "left")
    over = views.depths(spark, sf).join(views.truth(spark, sf), "key", "left_semi")
    binned = strata.depth_tertile(noted, "depth_est", over, cut=durable)
    return binned.groupBy("tool", "depth_bin").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives")
    )


def stratified_pr(spark, sf):
    return rounded(strata.stratified_areas(views.scored(spark, sf), views.depths(spark, sf), cut=durable))


def stratified_pr_points(spark, sf):
    """Ratios of counts as they are: one division is the same number in every engine."""
    return strata.stratified_pr_points(views.scored(spark, sf), views.depths(spark, sf), cut=durable)


# --- metrics on the scored table ---------------------------------------------------------------


def single_class(spark, sf):
    """The usual three tools and a fourth one that saw positives only."""
    scored = views.scored(spark, sf)
    one = scored.filter("tool = 'model' AND label = 1").withColumn("tool", F.lit("positives_only"))
    return rounded(metrics.metrics_table(scored.unionByName(one), cut=durable))


def report_rows(spark, sf):
    """Both classes for three tools and one class for a fourth, whose cells stay empty."""
    return sinks.report_rows(single_class(spark, sf))


def class_weights(spark, sf):
    weighted = metrics.class_weights(views.scored(spark, sf), group=["tool"])
    return weighted.select("tool", "key", "label", F.round("weight", 9).alias("weight"))


def balanced_sample(spark, sf):
    return resample.balanced_sample(views.scored(spark, sf), group=["tool"]).select("tool", "draw", "key", "label", "prob")


def weighted_resample(spark, sf):
    return resample.weighted_resample(views.scored(spark, sf), group=["tool"]).select("tool", "draw", "key", "label", "prob")


def _bootstrap(name: str) -> Query:
    def run(spark, sf):
        table = resample.bootstrap_areas(views.scored(spark, sf), BOOTSTRAP_REPS, SEED)
        return rounded(table.select("tool", name, f"{name}_lo", f"{name}_hi", "reps_used"))

    return run


def queries() -> dict[str, Query]:
    return {
        # keys and variants
        "normalize_key": normalize_key,
        "variant_key": variant_key,
        "split_key": split_key,
        "explode_alts": explode_alts,
        "site_windows": site_windows,
        "merge_label": merge_label,
        "truth_load": truth_load,
        "first_per_key": first_per_key,
        # scores
        "coerce_clip": coerce_clip,
        "minmax_scale": minmax_scale,
        "allele_fraction": allele_fraction,
        "allele_fraction_ad": allele_fraction_ad,
        "qual_logistic": qual_logistic,
        "score_chain": score_chain,
        "score_fallback": score_fallback,
        "info_score": info_score,
        "maf_scan": maf_scan,
        "truth_vcf_scan": truth_vcf_scan,
        "good_calls": good_calls,
        "quarantine": quarantine,
        "annotations": annotations,
        # joins and sets
        "align_universe": align_universe,
        "max_per_key": max_per_key,
        "clean_by_key": clean_by_key,
        "label_calls": label_calls,
        "paired_scores": paired_scores,
        "cyclic_zip": cyclic_zip,
        "drop_unlabelled": drop_unlabelled,
        "qc_merge": qc_merge,
        "feature_join": feature_join,
        "qc_vector": qc_vector,
        "calls_only_in_a": on_scored(lambda s: align.calls_only_in_a(s, "model", "caller_1")),
        "calls_in_both": on_scored(lambda s: align.calls_in_both(s, "model", "caller_1")),
        # regions and sequences
        "pileup_qc": pileup_qc,
        "pileup_regions": pileup_regions,
        "pileup_gaps": pileup_gaps,
        "pileup_mates": pileup_mates,
        "window_signal": window_signal,
        "seq_window": seq_window,
        "one_hot": one_hot,
        "fasta_chunks": fasta_chunks,
        "transpose_array": transpose_array,
        # learning
        "lr_scores": lr_scores,
        "epoch_metrics": epoch_metrics,
        "epoch_scores": epoch_scores,
        "linear_scores": linear_scores,
        "batch_scores": batch_scores,
        "class_weights": class_weights,
        # files
        "csv_scan": csv_scan,
        "prediction_scan": prediction_scan,
        "keyed_scan": keyed_scan,
        "signal_scan": signal_scan,
        "bed_lines": bed_lines,
        "metric_lines": metric_lines,
        "column_synonyms": column_synonyms,
        "second_chain": second_chain,
        # strata
        "fixed_bins": fixed_bins,
        "quantile_bins": quantile_bins,
        "stratified_pr": stratified_pr,
        "stratified_pr_points": stratified_pr_points,
        # counts and metrics
        "class_counts": on_scored(metrics.class_counts),
        "hard_calls": on_scored(metrics.hard_calls),
        "confusion_counts": on_scored(metrics.confusion_counts),
        "threshold_metrics": on_scored(metrics.threshold_metrics),
        "class_report": on_scored(metrics.class_report),
        "confusion_norm": on_scored(metrics.confusion_normalised),
        "brier": on_scored(metrics.brier),
        "metrics_table": on_points(metrics.metrics_from_curve),
        "single_class": single_class,
        "report_rows": report_rows,
        # curves and thresholds
        "roc_curve": on_points(curves.roc_points),
        "pr_curve": on_points(curves.pr_points),
        "auroc": on_points(lambda p: p.groupBy("tool").agg(curves.auroc().alias("auroc"))),
        "auprc": on_points(lambda p: p.groupBy("tool").agg(curves.auprc().alias("auprc"))),
        "average_precision": on_points(
            lambda p: p.groupBy("tool").agg(curves.average_precision().alias("average_precision"))
        ),
        "prec_at_recall": on_points(curves.precision_at_recall),
        "rec_at_precision": on_points(curves.recall_at_precision),
        "operating_points": on_points(curves.operating_points),
        "operating_points_reference": on_points(lambda p: curves.operating_points(p, rule="reference")),
        "threshold_sweep": on_scored(lambda s: curves.threshold_sweep(s, cut=durable)),
        "best_thresholds": on_scored(lambda s: curves.best_thresholds(curves.threshold_sweep(s, cut=durable))),
        "best_f1_grid": on_scored(curves.best_f1_on_grid),
        # distributions
        "calibration": on_scored(lambda s: distribution.calibration(s, cut=durable)),
        "score_summary": on_scored(lambda s: distribution.score_summary(s, cut=durable)),
        "score_hist": on_scored(distribution.score_histogram),
        # overlap and errors
        "overlap_counts": on_scored(lambda s: overlap.overlap_counts(s, TOOLS)),
        "overlap_regions": on_scored(lambda s: overlap.overlap_regions(s, TOOLS)),
        "top_errors": on_scored(errors.top_errors),
        "loci_list": lambda spark, sf: errors.loci(errors.top_errors(_scored_variants(spark, sf))),
        # resampling
        "hash_split": on_scored(resample.hash_split),
        "balanced_sample": balanced_sample,
        "weighted_resample": weighted_resample,
        "bootstrap_auroc": _bootstrap("auroc"),
        "bootstrap_auprc": _bootstrap("auprc"),
        "bootstrap_stratified": on_scored(lambda s: resample.bootstrap_stratified(s, STRATIFIED_REPS, SEED)),
        "bootstrap_delta": on_scored(
            lambda s: resample.paired_bootstrap_delta(s, "model", TOOLS[1:], BOOTSTRAP_REPS, SEED)
        ),
    }


def _scored_variants(spark, sf):
    """Variants scored by their position, under keys that hold one."""
    raw = views.variants(spark, sf)
    rows = raw.select(
        keys.variant_key().alias("key"), "label", F.pmod(F.col("pos") * 7919, F.lit(1000)).alias("score")
    )
    best = rows.groupBy("key").agg(F.max("label").alias("label"), F.max("score").alias("score"))
    return best.select("key", "label", (F.col("score") / 1000.0).alias("prob"), F.lit("model").alias("tool"))
