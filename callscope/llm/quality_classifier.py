"""Quality classifier: document evidence combined with shrunken host and path posteriors.

A logistic regression on a few counts of the text is fitted to a bounded sample of labelled
documents and gives each document's evidence. Documents are then counted by path and host: a
host's share of good documents is the mean of a Beta posterior whose prior is the corpus, a
path's one whose prior is its host, and the strength of a prior follows from how much sites
really differ (method of moments). A sparse site so falls back to its parent. The verdict adds
the evidence, as log odds, to what the path's posterior says beyond the corpus.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callscope.llm.common import store, whole

#: Most labelled documents in the fit: those of the smallest hashed id.
SAMPLE = 20_000
#: A site's influence in log odds is limited to this, so that it never outweighs clear evidence.
SITE_LIMIT = 2.0
RIDGE = 1.0
NAMES = ("length", "upper", "symbols", "shouts", "digits", "distinct", "word_length", "marks", "short", "variety", "stutter")


def features(text: Column) -> list[Column]:
    """Shares and counts of the text as doubles, none of them null."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    n, chars = F.size(words), F.greatest(F.length(text), F.lit(1))
    without = lambda letters: (F.length(text) - F.length(F.translate(text, letters, ""))) / chars
    return [
        F.log1p(n.cast("double")),
        F.regexp_count(text, F.lit(r"\p{Lu}")) / chars,
        without("#*$%&<>~^=@"),
        without("!"),
        without("0123456789"),
        F.size(F.array_distinct(words)) / F.sqrt(F.greatest(n, F.lit(1)).cast("double")) / 10,
        F.length(text) / F.greatest(n, F.lit(1)) / 10,
        without("|_{}[]\\"),
        (n < 10).cast("double"),
        F.size(F.array_distinct(words)) / F.greatest(n, F.lit(1)),
        F.size(F.filter(F.zip_with(words, F.slice(words, 2, F.greatest(n, F.lit(1))), lambda a, b: a == b), lambda x: x))
        / F.greatest(n, F.lit(1)),
    ]


def fit(documents: DataFrame, labels: DataFrame, target: str = "quality", sample: int = SAMPLE) -> np.ndarray:
    """Coefficients: constant, one per feature and one per squared feature.

    Without labels, or with labels of one class, all are zero and every document is kept.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("key")).agg(F.avg(target).alias("share"))
    known = known.orderBy(F.xxhash64("key"), "key").limit(sample)
    rows = documents.select(F.col("doc_id").cast("long").alias("key"), whole().alias("text"))
    rows = rows.join(F.broadcast(known), "key")  # at most ``sample`` rows of two numbers
    # Repeated rows of an id count once, so the sample stays bounded.
    rows = rows.select("key", "share", F.array(*features(F.col("text"))).alias("x"))
    rows = rows.groupBy("key").agg(F.first("share"), F.min("x")).collect()
    width = 1 + 2 * len(NAMES)
    y = np.array([row[1] >= 0.5 for row in rows], float)
    if not rows or y.min() == y.max():
        return np.zeros(width)
    x = np.array([row[2] for row in rows], float)
    x = np.column_stack([np.ones(len(x)), x, x * x])
    scale = np.maximum(np.abs(x).max(axis=0), 1e-9)
    x, weights = x / scale, np.zeros(width)
    penalty = np.full(width, RIDGE)
    penalty[0] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x @ weights).clip(-30, 30)))
        slope = x.T @ (y - p) - penalty * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, slope)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights / scale


def log_odds(text: Column, weights: np.ndarray) -> Column:
    """The classifier's log odds of good quality as an expression."""
    x = features(text)
    terms = [value * F.lit(float(w)) for value, w in zip(x, weights[1 : len(x) + 1], strict=True)]
    terms += [value * value * F.lit(float(w)) for value, w in zip(x, weights[len(x) + 1 :], strict=True)]
    total = reduce(lambda a, b: a + b, terms, F.lit(float(weights[0])))
    return F.greatest(F.least(total, F.lit(30.0)), F.lit(-30.0))


def _odds(share: Column) -> Column:
    return F.log(share / (1 - share))


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior strength, in documents, from the spread of the groups' shares around their parents'."""
    part = groups.agg(
        F.sum(F.col("n") * (F.col("good") / F.col("n") - mean) * (F.col("good") / F.col("n") - mean)).alias("spread"),
        F.sum(mean * (1 - mean)).alias("noise"),
        F.sum(F.col("n") * mean * (1 - mean)).alias("most"),
    ).first()
    if not part["most"]:
        return 1.0
    # spread = noise + share * (most - noise), where share = 1 / (strength + 1)
    share = (part["spread"] - part["noise"]) / max(part["most"] - part["noise"], 1e-9)
    return float(np.clip(1 / share - 1 if share > 0 else 1e6, 1.0, 1e6))


def site_shares(scored: DataFrame) -> DataFrame:
    """site_host, site_path, host_share, path_share and shift (log odds beyond the corpus).

    ``scored`` has host, path and p. Rows are summed by (host, path) before they are shuffled.
    """
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("good"))
    paths = store(paths, "paths")
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    mean = ((total["good"] or 0.0) + 0.5) / ((total["n"] or 0) + 1.0)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    m = _strength(hosts, F.lit(mean))
    hosts = hosts.select(
        "host", F.col("n").alias("host_n"), ((F.col("good") + m * mean) / (F.col("n") + m)).alias("host_share")
    )
    both = paths.join(hosts, "host")
    k = _strength(both, F.col("host_share"))
    share = ((F.col("good") + k * F.col("host_share")) / (F.col("n") + k)).alias("path_share")
    out = both.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "host_share", share)
    shift = _odds(F.col("path_share").cast("double").alias("s")) - F.lit(float(np.log(mean / (1 - mean))))
    return store(out.withColumn("shift", F.greatest(F.least(shift, F.lit(SITE_LIMIT)), F.lit(-SITE_LIMIT))), "sites")


def _site(documents: DataFrame, name: str | None) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in documents.columns else F.lit("")


def classify(
    documents: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", target: str = "quality"
) -> DataFrame:
    """doc_id, p_doc, host_share, path_share, score and kept for every document.

    A null text is empty; a null or missing host or path is a site of its own. Repeated rows are
    counted and kept as they come. Without usable labels every document is kept.
    """
    weights = fit(documents, labels, target)
    scored = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        _site(documents, host).alias("host"),
        _site(documents, path).alias("path"),
        log_odds(whole(), weights).alias("evidence"),
    )
    scored = store(scored.withColumn("p", 1 / (1 + F.exp(-F.col("evidence")))), "scored")
    sites = site_shares(scored)
    found = scored.join(
        sites, (scored.host == sites.site_host) & (scored.path == sites.site_path), "left"
    )
    score = 1 / (1 + F.exp(-(F.col("evidence") + F.col("shift"))))
    return found.select(
        "doc_id", F.col("p").alias("p_doc"), "host_share", "path_share", score.alias("score"), (score >= 0.5).alias("kept")
    )


def accepted(
    documents: DataFrame, labels: DataFrame, *, host: str = "source", path: str = "lang", target: str = "quality"
) -> DataFrame:
    """The documents that ``classify`` keeps, with all their columns."""
    weights = fit(documents, labels, target)
    site = [_site(documents, host).alias("host"), _site(documents, path).alias("path")]
    packed = documents.select(F.struct("*").alias("row"), *site, log_odds(whole(), weights).alias("evidence"))
    packed = store(packed, "packed")  # the features of a text are computed once
    sites = site_shares(packed.select("host", "path", (1 / (1 + F.exp(-F.col("evidence")))).alias("p")))
    found = packed.join(sites, (packed.host == sites.site_host) & (packed.path == sites.site_path), "left")
    return found.where("evidence + shift >= 0").select("row.*")
