"""The registered queries as plain SQL over the benchmark tables, written independently of the operators."""

from __future__ import annotations

import math

from callscope.functions.hashing import (
    DRAW_RANGE,
    MASK,
    MULTIPLIERS,
    POISSON_ONE_CDF,
    SECOND_DRAW,
    STREAM_STEP,
)
from callscope.operators.resample import SPARE
from callscope.plans.queries import (
    BOOTSTRAP_REPS,
    SEED,
    SEQUENCE_RADIUS,
    STRATIFIED_REPS,
    TRAIN_BATCHES,
    TRAIN_EPOCHS,
    WINDOW_RADIUS,
)

# name -> (names it needs, SQL)
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "truth": (
        (),
        "SELECT CAST(o_orderkey AS VARCHAR) AS key, CAST(o_orderstatus = 'F' AS INT) AS label FROM orders",
    ),
    "calls": (
        (),
        """
        SELECT 'model' AS tool, CAST(o_orderkey AS VARCHAR) AS key,
               (7 * CAST(FLOOR(o_totalprice / 5) AS BIGINT) + 300000 * CAST(o_orderstatus = 'F' AS INT)) / 1e6 AS prob
        FROM orders
        UNION ALL
        SELECT 'caller_1', CAST(l_orderkey AS VARCHAR), CAST(l_quantity AS BIGINT) / 5e1
        FROM lineitem WHERE l_linestatus = 'F'
        UNION ALL
        SELECT 'caller_2', CAST(l_orderkey AS VARCHAR), 1e0
        FROM lineitem WHERE l_returnflag = 'A' AND l_discount >= 0.08
        """,
    ),
    "scored": (
        ("truth", "calls"),
        """
        SELECT t.tool, u.key, u.label, LEAST(1e0, GREATEST(0e0, COALESCE(c.prob, 0e0))) AS prob
        FROM truth u CROSS JOIN (VALUES ('model'), ('caller_1'), ('caller_2')) t(tool)
        LEFT JOIN (SELECT tool, key, MAX(prob) AS prob FROM calls GROUP BY tool, key) c
          ON c.tool = t.tool AND c.key = u.key
        """,
    ),
    "counts": (
        ("scored",),
        """
        SELECT tool, prob AS score, CAST(SUM(label) AS BIGINT) AS pos, CAST(SUM(1 - label) AS BIGINT) AS neg
        FROM scored GROUP BY tool, prob
        """,
    ),
    "points": (
        ("counts",),
        """
        SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
               SUM(pos) OVER (PARTITION BY tool) AS p, SUM(neg) OVER (PARTITION BY tool) AS n
        FROM counts WINDOW w AS (PARTITION BY tool ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
        """,
    ),
    "pr": (
        ("points",),
        """
        SELECT *, tp / (tp + fp) AS prec, tp / p AS rec,
               LAG(tp / (tp + fp), 1, 1e0) OVER d AS prior_prec,
               LAG(tp / p, 1, 0e0) OVER d AS prior_rec,
               LEAD(score) OVER d AS lower_score
        FROM points WINDOW d AS (PARTITION BY tool ORDER BY score DESC)
        """,
    ),
    "variants": (
        (),
        """
        SELECT CONCAT('chr', CAST(l_suppkey % 22 + 1 AS VARCHAR)) AS chrom, l_partkey * 10 + l_linenumber AS pos,
               SUBSTR('acgt', CAST(l_linenumber % 4 + 1 AS INT), 1) AS ref,
               CONCAT(SUBSTR('CGTA', CAST(l_linenumber % 4 + 1 AS INT), 1),
                      CASE WHEN l_orderkey % 7 = 0 THEN ',T' ELSE '' END) AS alt,
               CAST(l_returnflag = 'R' AS INT) AS label, CAST(l_returnflag = 'R' AS INT) AS src_rank
        FROM lineitem
        """,
    ),
    "keyed": (
        ("variants",),
        """
        SELECT CONCAT(REGEXP_REPLACE(chrom, '^chr', ''), ':', CAST(pos AS VARCHAR), ':', UPPER(ref), ':',
                      UPPER(SPLIT_PART(alt, ',', 1))) AS key, label, src_rank, pos
        FROM variants
        """,
    ),
    "raw": (
        (),
        """
        SELECT l_orderkey AS id, l_linenumber AS rn,
               CASE WHEN l_orderkey % 11 = 0 THEN 'x'
                    ELSE CAST(CAST(FLOOR(l_extendedprice) AS BIGINT) AS VARCHAR) END AS tlod,
               CAST(l_quantity AS BIGINT) AS t_ref_count, CAST(l_linenumber AS BIGINT) - 1 AS t_alt_count,
               CONCAT(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), ',', CAST(l_linenumber AS VARCHAR)) AS ad,
               CAST(l_quantity AS BIGINT) AS qual,
               CASE WHEN l_returnflag = 'N' THEN 'PASS' ELSE 'weak' END AS filter
        FROM lineitem
        """,
    ),
    "depths": (
        ("raw",),
        """
        SELECT CAST(id AS VARCHAR) AS key,
               CAST(SUM(t_alt_count) AS DOUBLE) / NULLIF(SUM(t_ref_count + t_alt_count), 0) AS vaf_est,
               CAST(SUM(t_ref_count + t_alt_count) AS DOUBLE) AS depth_est
        FROM raw GROUP BY id
        """,
    ),
    "noted": (
        ("scored", "depths"),
        """
        SELECT s.*, d.vaf_est, d.depth_est,
               CASE WHEN vaf_est >= 0 AND vaf_est < 0.05 THEN '<5%' WHEN vaf_est >= 0.05 AND vaf_est < 0.1 THEN '5-10%'
                    WHEN vaf_est >= 0.1 AND vaf_est < 0.2 THEN '10-20%'
                    WHEN vaf_est >= 0.2 AND vaf_est < 1.01 THEN '>=20%' END AS vaf_bin
        FROM scored s LEFT JOIN depths d USING (key)
        """,
    ),
    "edges": (
        ("depths", "truth"),
        """
        SELECT MIN(depth_est) AS e0, QUANTILE_CONT(depth_est, 1 / 3) AS e1, QUANTILE_CONT(depth_est, 2 / 3) AS e2,
               MAX(depth_est) AS e3
        FROM depths SEMI JOIN truth USING (key)
        """,
    ),
    "binned": (
        ("noted", "edges"),
        """
        SELECT noted.*, CASE WHEN depth_est >= e0 AND depth_est <= e1 THEN 'low'
                             WHEN depth_est > e1 AND depth_est <= e2 THEN 'med'
                             WHEN depth_est > e2 AND depth_est <= e3 THEN 'high' END AS depth_bin
        FROM noted, edges
        """,
    ),
    "sites": (
        (),
        """
        SELECT CAST(p_partkey AS VARCHAR) AS key, p_partkey % 22 AS chrom, p_partkey AS pos0,
               SUBSTR('ACGT', CAST(p_size % 4 + 1 AS INT), 1) AS alt FROM part
        """,
    ),
    "evidence": (
        (),
        """
        SELECT COALESCE(a.key, b.key, c.key) AS key, COALESCE(dp, 0e0) AS "DP", COALESCE(ad, 0e0) AS "AD",
               COALESCE(vaf, 0e0) AS "VAF", COALESCE(mq, 0e0) AS "MQ", 0e0 AS "SB",
               COALESCE(a.x, 0e0) AS "MAP", COALESCE(b.x, 0e0) AS "RTIM"
        FROM (SELECT CAST(c_custkey AS VARCHAR) AS key, c_acctbal AS x FROM customer) a
        FULL JOIN (SELECT CAST(s_suppkey AS VARCHAR) AS key, s_acctbal AS x FROM supplier) b ON a.key = b.key
        FULL JOIN (SELECT CAST(p_partkey + 50 AS VARCHAR) AS key, CAST(p_size AS DOUBLE) AS dp,
                          CASE WHEN p_size % 5 <> 0 THEN CAST(p_size AS DOUBLE) END AS ad,
                          p_size / 1e2 AS vaf, p_retailprice AS mq FROM part) c
          ON c.key = COALESCE(a.key, b.key)
        """,
    ),
    "featured": (
        ("evidence",),
        """
        SELECT CAST(l_partkey AS VARCHAR) AS key, l_orderkey, l_linenumber, COALESCE("DP", 0e0) AS "DP",
               COALESCE("AD", 0e0) AS "AD", COALESCE("VAF", 0e0) AS "VAF", COALESCE("MQ", 0e0) AS "MQ",
               COALESCE("SB", 0e0) AS "SB", COALESCE("MAP", 0e0) AS "MAP", COALESCE("RTIM", 0e0) AS "RTIM"
        FROM lineitem LEFT JOIN evidence e ON e.key = CAST(l_partkey AS VARCHAR)
        """,
    ),
    "seqs": (
        (),
        f"""
        SELECT o_orderkey AS site, CAST(doc AS VARCHAR) AS contig, 1 + o_orderkey * 7919 % (COALESCE(LENGTH(text), 0) + 20) AS pos,
               o_orderkey * 7919 % (COALESCE(LENGTH(text), 0) + 20) - {SEQUENCE_RADIUS} AS s, text
        FROM (SELECT o_orderkey, o_orderkey % ((SELECT COUNT(*) FROM documents) + 5) AS doc FROM orders)
        LEFT JOIN documents ON doc_id = doc
        """,
    ),
    "cut": (
        ("seqs",),
        f"""
        SELECT site, contig, pos,
               CASE WHEN s + {2 * SEQUENCE_RADIUS + 1} > 0 AND s < LENGTH(text) THEN
                 RPAD(CONCAT(REPEAT('N', CAST(GREATEST(-s, 0) AS INT)),
                             SUBSTRING(text, GREATEST(s, 0) + 1, {2 * SEQUENCE_RADIUS + 1} - GREATEST(-s, 0))),
                      {2 * SEQUENCE_RADIUS + 1}, 'N') END AS seq
        FROM seqs
        """,
    ),
    "grid": (
        ("scored",),
        """
        SELECT tool, prob AS threshold FROM scored
        UNION
        SELECT tool, i / 2e2 FROM (SELECT DISTINCT tool FROM scored), RANGE(201) g(i)
        """,
    ),
    "sweep": (
        ("grid", "counts"),
        """
        SELECT tool, threshold, tp, fp, n - fp AS tn, p - tp AS fn,
               COALESCE(tp / NULLIF(tp + fp, 0), 0) AS precision, COALESCE(tp / NULLIF(p, 0), 0) AS recall,
               COALESCE(2 * tp / NULLIF(tp + fp + p, 0), 0) AS f1, (tp + n - fp) / (p + n) AS accuracy,
               COALESCE(tp / NULLIF(p, 0), 0) AS tpr, COALESCE(fp / NULLIF(n, 0), 0) AS fpr,
               COALESCE(tp / NULLIF(p, 0), 0) - COALESCE(fp / NULLIF(n, 0), 0) AS youden
        FROM (SELECT g.tool, threshold, CAST(COALESCE(SUM(pos) OVER w, 0) AS BIGINT) AS tp,
                     CAST(COALESCE(SUM(neg) OVER w, 0) AS BIGINT) AS fp,
                     CAST(SUM(pos) OVER (PARTITION BY g.tool) AS BIGINT) AS p,
                     CAST(SUM(neg) OVER (PARTITION BY g.tool) AS BIGINT) AS n
              FROM grid g LEFT JOIN counts c ON c.tool = g.tool AND c.score = threshold
              WINDOW w AS (PARTITION BY g.tool ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING))
        """,
    ),
    "confusion": (
        ("scored",),
        """
        SELECT tool, COUNT(*) FILTER (WHERE label = 1 AND prob >= 0.5) AS tp,
               COUNT(*) FILTER (WHERE label = 0 AND prob >= 0.5) AS fp,
               COUNT(*) FILTER (WHERE label = 0 AND prob < 0.5) AS tn,
               COUNT(*) FILTER (WHERE label = 1 AND prob < 0.5) AS fn
        FROM scored GROUP BY tool
        """,
    ),
    "masks": (
        ("scored",),
        """
        SELECT key, CAST(SUM(CASE tool WHEN 'model' THEN 1 WHEN 'caller_1' THEN 2 ELSE 4 END) AS INT) AS mask
        FROM scored WHERE prob >= 0.5 GROUP BY key
        """,
    ),
    "model": (("scored",), "SELECT key, label, prob FROM scored WHERE tool = 'model'"),
    "errs": (
        ("scored",),
        """
        SELECT tool, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS err, rank, key, label, prob
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY tool, label ORDER BY
                CASE WHEN label = 0 THEN -prob ELSE prob END, key) AS rank FROM scored) WHERE rank <= 20
        """,
    ),
    "box": (
        ("scored",),
        """
        SELECT tool, label, COUNT(*) AS n_rows, AVG(prob) AS mean, MIN(prob) AS lowest, MAX(prob) AS highest,
               QUANTILE_CONT(prob, 0.25) AS q1, QUANTILE_CONT(prob, 0.5) AS median, QUANTILE_CONT(prob, 0.75) AS q3
        FROM scored GROUP BY tool, label
        """,
    ),
    "classes": (
        ("scored",),
        """
        SELECT tool, label, key, prob,
               ROW_NUMBER() OVER (PARTITION BY tool, label ORDER BY MD5(key), key) - 1 AS idx,
               COUNT(*) OVER (PARTITION BY tool, label) AS size
        FROM scored
        """,
    ),
}


def draw_sql(source: str, stream: str, seed: int, name: str) -> str:
    """SELECT that adds one hashed draw to ``source``, which has ``key`` and whatever ``stream`` uses."""

    def round_(x: str, multiplier: int) -> str:
        return f"(xor({x}, {x} >> 15) * {multiplier}) & {MASK}"

    a, b = MULTIPLIERS
    steps = [
        f"xor(('0x' || SUBSTR(MD5(key), 1, 7))::BIGINT, (({stream}) * {STREAM_STEP} + {seed})::BIGINT & {MASK})",
        round_("s0", a),
        round_("s1", b),
        "xor(xor(s2, s2 >> 13), ('0x' || SUBSTR(MD5(key), 8, 7))::BIGINT)",
        round_("s3", a),
        round_("s4", b),
        "xor(s5, s5 >> 13)",
    ]
    sql = source
    for i, step in enumerate(steps):
        # Nested, not as aliases of one SELECT: aliases are written out wherever they are used.
        before = f" EXCLUDE (s{i - 1})" if i else ""
        sql = f"(SELECT *{before}, {step} AS {name if i == len(steps) - 1 else f's{i}'} FROM {sql})"
    return f"SELECT * FROM {sql}"


def index_sql(source: str, stream: str, seed: int, size: str, name: str) -> str:
    first = draw_sql(source, stream, seed, "d1")
    both = draw_sql(f"({first})", stream, seed + SECOND_DRAW, "d2")
    return f"SELECT * EXCLUDE (d1, d2), (d1 * {DRAW_RANGE} + d2) % ({size}) AS {name} FROM ({both})"


def poisson_sql(draw: str) -> str:
    cases = " ".join(f"WHEN {draw} < {int(c * DRAW_RANGE)} THEN {k}" for k, c in enumerate(POISSON_ONE_CDF))
    return f"CASE {cases} ELSE {len(POISSON_ONE_CDF)} END"


def areas_sql(weighted: str) -> str:
    """AUROC and AUPRC per (tool, rep) from rows ``tool, rep, prob, label, w``."""
    return f"""
        SELECT tool, rep,
               CAST(SUM(neg * (2 * tp - pos)) AS DOUBLE) / (2e0 * MAX(p) * MAX(n)) AS auroc,
               SUM(pos / p * (tp / (tp + fp) + CASE WHEN tp + fp = pos + neg THEN 1e0
                   ELSE (tp - pos) / NULLIF(tp - pos + fp - neg, 0) END) / 2) AS auprc
        FROM (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
                     SUM(pos) OVER g AS p, SUM(neg) OVER g AS n
              FROM (SELECT tool, rep, prob, SUM(w * label) AS pos, SUM(w * (1 - label)) AS neg
                    FROM ({weighted}) WHERE w > 0 GROUP BY tool, rep, prob)
              WINDOW w AS (PARTITION BY tool, rep ORDER BY prob DESC ROWS UNBOUNDED PRECEDING),
                     g AS (PARTITION BY tool, rep))
        WHERE p > 0 AND n > 0 GROUP BY tool, rep
    """


def interval_sql(name: str) -> str:
    replicate = f"CASE WHEN rep >= 0 THEN {name} END"
    return (
        f"ROUND(MAX(CASE WHEN rep < 0 THEN {name} END), 6) AS {name}, "
        f"ROUND(QUANTILE_CONT({replicate}, 0.025), 6) AS {name}_lo, "
        f"ROUND(QUANTILE_CONT({replicate}, 0.975), 6) AS {name}_hi"
    )


def key_weights_sql() -> str:
    exploded = f"(SELECT tool, key, label, prob, r.rep FROM scored, RANGE(-1, {BOOTSTRAP_REPS}) r(rep))"
    drawn = draw_sql(exploded, "rep", SEED, "u")
    return f"SELECT tool, key, rep, prob, label, CASE WHEN rep < 0 THEN 1 ELSE {poisson_sql('u')} END AS w FROM ({drawn})"


PARTS["boot"] = (("scored",), areas_sql(key_weights_sql()))
PARTS["split_draw"] = (("scored",), draw_sql("scored", "0", 42, "u"))
PARTS["balanced_draws"] = (
    ("classes",),
    index_sql(
        "(SELECT tool, key, others FROM classes JOIN (SELECT tool, COUNT(*) AS others FROM classes WHERE label = 0 "
        "GROUP BY tool) USING (tool) WHERE label = 1)",
        "0",
        42,
        "others",
        "idx",
    ),
)
PARTS["coins"] = (
    ("scored",),
    f"SELECT tool, key, CAST(u / {float(DRAW_RANGE)} < 0.5 AS INT) AS label FROM "
    f"({draw_sql('(SELECT tool, key FROM scored)', '1', 42, 'u')})",
)
PARTS["weighted_draws"] = (
    ("coins", "classes"),
    index_sql(
        "(SELECT coins.*, size FROM coins JOIN (SELECT DISTINCT tool, label, size FROM classes) USING (tool, label))",
        "2",
        42,
        "size",
        "idx",
    ),
)


def stratified_bound(k: int) -> str:
    """The k-th bound of Poisson weights whose mean column is ``mean``."""
    terms = " + ".join(f"EXP(-mean) * POW(mean, {i}) / {math.factorial(i)}e0" for i in range(k + 1))
    return f"CAST(FLOOR(({terms}) * {DRAW_RANGE}) AS BIGINT)"


PARTS["class_keys"] = (("scored",), "SELECT key, MAX(label) AS label FROM scored GROUP BY key")
PARTS["class_bounds"] = (
    ("class_keys",),
    f"SELECT label, size, {', '.join(f'{stratified_bound(k)} AS b{k}' for k in range(13))} FROM ("
    f"SELECT label, COUNT(*) AS size, GREATEST(0e0, 1e0 - {SPARE} / SQRT(COUNT(*))) AS mean FROM class_keys GROUP BY label)",
)
PARTS["class_weights_drawn"] = (
    ("class_keys", "class_bounds"),
    f"SELECT key, label, rep, size, {' + '.join(f'CAST(u >= b{k} AS BIGINT)' for k in range(13))} AS w FROM ("
    + draw_sql(f"(SELECT key, label, r.rep FROM class_keys, RANGE(0, {STRATIFIED_REPS}) r(rep))", "rep", SEED, "u")
    + ") JOIN class_bounds USING (label)",
)
PARTS["class_sums"] = (
    ("class_weights_drawn",),
    "SELECT label, rep, MAX(size) AS size, SUM(w) AS total FROM class_weights_drawn GROUP BY label, rep",
)
PARTS["class_extra"] = (
    ("class_sums", "class_keys"),
    "SELECT c.key, d.label, d.rep, COUNT(*) AS w FROM ("
    + index_sql(
        "(SELECT label, rep, size, label || '/' || j AS key FROM (SELECT label, rep, size, "
        "UNNEST(RANGE(CAST(size - CASE WHEN total > size THEN 0 ELSE total END AS BIGINT))) AS j FROM class_sums))",
        "rep",
        SEED,
        "size",
        "idx",
    )
    + ") d JOIN (SELECT key, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY MD5(key), key) - 1 AS idx FROM class_keys) c "
    "ON c.label = d.label AND c.idx = d.idx GROUP BY c.key, d.label, d.rep",
)
PARTS["stratified_boot"] = (
    ("class_weights_drawn", "class_sums", "class_extra", "scored"),
    areas_sql(
        """
        SELECT s.tool, x.rep, s.prob, s.label, x.w FROM (
            SELECT key, rep, SUM(w) AS w FROM (
                SELECT key, rep, w FROM class_weights_drawn JOIN class_sums USING (label, rep)
                WHERE class_sums.total <= class_sums.size AND w > 0
                UNION ALL SELECT key, rep, w FROM class_extra) GROUP BY key, rep) x
        JOIN scored s USING (key)
        UNION ALL SELECT tool, -1, prob, label, 1 FROM scored
        """
    ),
)



def training_sql() -> list[tuple[str, str]]:
    """The parts of a fit, step by step: rows, scaling, coefficients after each step, held-out areas."""
    drawn = draw_sql("(" + draw_sql(
        """(SELECT CONCAT(l_orderkey, ':', l_linenumber) AS key, CAST(CAST(l_quantity AS BIGINT) AS DOUBLE) AS x1,
                   CAST(l_partkey % 40 AS DOUBLE) AS x2, CAST(l_returnflag = 'R' AS DOUBLE) AS x3,
                   CAST(CAST(l_quantity AS BIGINT) + l_partkey % 40 + 10 * CAST(l_returnflag = 'R' AS INT)
                        + l_suppkey % 30 > 62 AS DOUBLE) AS y FROM lineitem)""", "0", 42, "u") + ")", "1", 42, "b")
    moment = lambda i: f"AVG(x{i}) AS m{i}, SQRT(GREATEST(AVG(x{i} * x{i}) - AVG(x{i}) * AVG(x{i}), 0)) AS s{i}"
    scaled = ", ".join(f"(x{i} - m{i}) / COALESCE(NULLIF(s{i}, 0), 1) AS z{i}" for i in (1, 2, 3))
    parts = [
        ("drawn", drawn),
        ("fit_rows", f"SELECT *, u / {float(DRAW_RANGE)} < 0.8 AS train FROM drawn"),
        ("fit_scale", f"SELECT {', '.join(map(moment, (1, 2, 3)))} FROM fit_rows WHERE train"),
        ("fit_z", f"SELECT key, train, b % {TRAIN_BATCHES} AS batch, y, {scaled}, 1e0 AS z4 FROM fit_rows, fit_scale"),
        ("c0", "SELECT " + ", ".join(f"0e0 AS c{i}, 0e0 AS f{i}, 0e0 AS q{i}" for i in (1, 2, 3, 4))),
    ]
    odds = "1 / (1 + EXP(-(" + " + ".join(f"c{i} * z{i}" for i in (1, 2, 3, 4)) + ")))"
    loss = "SUM(-LN(CASE WHEN y = 1 THEN GREATEST(p, 1e-15) ELSE GREATEST(1 - p, 1e-15) END))"
    for k in range(1, TRAIN_EPOCHS * TRAIN_BATCHES + 1):
        sums = ", ".join(f"SUM((p - y) * z{i}) / COUNT(*) AS g{i}" for i in (1, 2, 3, 4))
        parts.append((f"g{k}", f"SELECT {sums}, {loss} AS loss, COUNT(*) AS n FROM (SELECT *, {odds} AS p FROM fit_z, c{k - 1} "
                               f"WHERE train AND batch = {(k - 1) % TRAIN_BATCHES})"))
        moments = ", ".join(f"c{i}, 0.9e0 * f{i} + (1 - 0.9e0) * g{i} AS f{i}, 0.999e0 * q{i} + (1 - 0.999e0) * g{i} * g{i} AS q{i}"
                            for i in (1, 2, 3, 4))
        moved = ", ".join(f"c{i} - 0.1e0 * (f{i} / (1 - POW(0.9e0, {k}))) / (SQRT(q{i} / (1 - POW(0.999e0, {k}))) + 1e-8) AS c{i}, f{i}, q{i}"
                          for i in (1, 2, 3, 4))
        parts.append((f"c{k}", f"SELECT {moved} FROM (SELECT {moments} FROM c{k - 1}, g{k})"))
    for e in range(1, TRAIN_EPOCHS + 1):
        own = [f"g{k}" for k in range((e - 1) * TRAIN_BATCHES + 1, e * TRAIN_BATCHES + 1)]
        parts.append((f"h{e}", f"SELECT y, ROUND({odds}, 12) AS p FROM fit_z, c{e * TRAIN_BATCHES} WHERE NOT train"))
        parts.append((f"e{e}", f"""
            SELECT {e} AS epoch, ({' + '.join(f'(SELECT loss FROM {g})' for g in own)}) / ({' + '.join(f'(SELECT n FROM {g})' for g in own)}) AS train_loss,
                   (SELECT {loss} / COUNT(*) FROM h{e}) AS valid_loss,
                   SUM(neg * (2 * tp - pos)) / (2e0 * MAX(tp) * MAX(fp)) AS auroc,
                   SUM(pos / (SELECT SUM(y) FROM h{e}) * tp / (tp + fp)) AS average_precision
            FROM (SELECT pos, neg, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp
                  FROM (SELECT p, SUM(y) AS pos, SUM(1 - y) AS neg FROM h{e} GROUP BY p)
                  WINDOW w AS (ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""))
    return parts


METRICS = """
    SELECT tool, ROUND(auroc, 6) AS auroc, ROUND(auprc, 6) AS auprc,
           ROUND(CASE WHEN ok THEN COALESCE(2 * tp / NULLIF(tp + fp + p, 0), 0) END, 6) AS f1,
           ROUND(CASE WHEN ok THEN COALESCE(tp / NULLIF(tp + fp, 0), 0) END, 6) AS precision,
           ROUND(CASE WHEN ok THEN tp / p END, 6) AS recall,
           ROUND(CASE WHEN ok THEN (n - fp) / n END, 6) AS specificity,
           ROUND(CASE WHEN ok THEN prec_at_r95 END, 6) AS prec_at_r95,
           ROUND(CASE WHEN ok THEN rec_at_p90 END, 6) AS rec_at_p90,
           CAST(p + n AS BIGINT) AS n_rows, ROUND(p / (p + n), 6) AS positive_rate
    FROM (SELECT tool, MAX(p) > 0 AND MAX(n) > 0 AS ok, MAX(p) AS p, MAX(n) AS n,
                 CAST(SUM(neg * (2 * tp - pos)) AS DOUBLE) / NULLIF(2e0 * MAX(p) * MAX(n), 0) AS auroc,
                 CASE WHEN MAX(n) > 0 THEN SUM(pos / p * (prec + prior_prec) / 2) END AS auprc,
                 MAX(prec) FILTER (WHERE rec >= 0.95) AS prec_at_r95,
                 COALESCE(MAX(rec) FILTER (WHERE prec >= 0.90), 0) AS rec_at_p90,
                 COALESCE(SUM(pos) FILTER (WHERE score >= 0.5), 0) AS tp,
                 COALESCE(SUM(neg) FILTER (WHERE score >= 0.5), 0) AS fp
          FROM {pr} GROUP BY tool)
"""
PARTS["metrics"] = (("pr",), METRICS.format(pr="pr"))
PARTS["four_tools"] = (
    ("scored",),
    "SELECT * FROM scored UNION ALL SELECT 'positives_only', key, label, prob FROM scored "
    "WHERE tool = 'model' AND label = 1",
)
PARTS["four_pr"] = (
    ("four_tools",),
    """
    SELECT *, tp / (tp + fp) AS prec, tp / p AS rec,
           LAG(tp / (tp + fp), 1, 1e0) OVER (PARTITION BY tool ORDER BY score DESC) AS prior_prec
    FROM (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp,
                 SUM(pos) OVER (PARTITION BY tool) AS p, SUM(neg) OVER (PARTITION BY tool) AS n
          FROM (SELECT tool, prob AS score, SUM(label) AS pos, SUM(1 - label) AS neg
                FROM four_tools GROUP BY tool, prob)
          WINDOW w AS (PARTITION BY tool ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
    """,
)
PARTS["four_metrics"] = (("four_pr",), METRICS.format(pr="four_pr"))


def _operating(reference: bool) -> str:
    """Thresholds by position on the descending curve, then counts recomputed at the threshold."""
    low = "COALESCE(lower_score, score)" if reference else "score"
    end = "(SELECT MAX(score) FROM pr q WHERE q.tool = pr.tool)" if reference else "NULL"
    settings = []
    for kind, target in (("Recall", 0.95), ("Precision", 0.98), ("Precision", 0.90)):
        if kind == "Recall":
            pick = f"ARG_MAX({low}, score) FILTER (WHERE rec >= {target})"
        else:
            pick = f"COALESCE(ARG_MIN({low}, score) FILTER (WHERE prec >= {target}), {end})"
        settings.append(
            f"SELECT tool, '{kind}@{target:.2f}' AS setting, {pick} AS threshold, MAX(p) AS p, MAX(n) AS n "
            "FROM pr GROUP BY tool"
        )
    return f"""
        SELECT o.tool, setting, ROUND(threshold, 6) AS threshold, ROUND(tp / (tp + fp), 6) AS precision,
               ROUND(tp / p, 6) AS recall, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
               CAST(n - fp AS BIGINT) AS tn, CAST(p - tp AS BIGINT) AS fn
        FROM ({' UNION ALL '.join(settings)}) o
        LEFT JOIN (SELECT tool, score, tp, fp FROM points) c ON c.tool = o.tool AND c.score = o.threshold
    """


def _one_hot(base: str) -> str:
    letters = "STRING_SPLIT(TRANSLATE(seq, 'acgt', 'ACGT'), '')"
    return f"ARRAY_TO_STRING(LIST_TRANSFORM({letters}, lambda x: CASE WHEN x = '{base}' THEN '1' ELSE '0' END), '')"


def _best(criterion: str) -> str:
    return (
        f"SELECT tool, '{criterion}' AS criterion, threshold, precision, recall, f1, accuracy, tpr, fpr, youden "
        f"FROM sweep QUALIFY ROW_NUMBER() OVER (PARTITION BY tool ORDER BY {criterion} DESC, threshold) = 1"
    )


def _strata(kind: str) -> str:
    return f"""
        SELECT tool, '{kind}' AS stratum, bin, CAST(MAX(p) AS BIGINT) AS positives, CAST(MAX(n) AS BIGINT) AS negatives,
               ROUND(CAST(SUM(neg * (2 * tp - pos)) AS DOUBLE) / (2e0 * MAX(p) * MAX(n)), 6) AS auroc,
               ROUND(SUM(pos / p * (tp / (tp + fp) + CASE WHEN tp + fp = pos + neg THEN 1e0
                   ELSE (tp - pos) / NULLIF(tp - pos + fp - neg, 0) END) / 2), 6) AS auprc
        FROM (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER g AS p, SUM(neg) OVER g AS n
              FROM (SELECT tool, {kind}_bin AS bin, prob, SUM(label) AS pos, SUM(1 - label) AS neg
                    FROM binned WHERE {kind}_bin IS NOT NULL GROUP BY tool, {kind}_bin, prob)
              WINDOW w AS (PARTITION BY tool, bin ORDER BY prob DESC ROWS UNBOUNDED PRECEDING),
                     g AS (PARTITION BY tool, bin))
        WHERE p > 0 AND n > 0 GROUP BY tool, bin
    """


def _strata_points(kind: str) -> str:
    return f"""
        SELECT tool, '{kind}' AS stratum, bin, UNNEST([threshold, CASE WHEN first THEN -1e0 END]) AS threshold,
               UNNEST([tp / (tp + fp), CASE WHEN first THEN 1e0 END]) AS precision,
               UNNEST([tp / p, CASE WHEN first THEN 0e0 END]) AS recall
        FROM (SELECT *, prob AS threshold, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER g AS p,
                     SUM(neg) OVER g AS n, ROW_NUMBER() OVER w = 1 AS first
              FROM (SELECT tool, {kind}_bin AS bin, prob, SUM(label) AS pos, SUM(1 - label) AS neg
                    FROM binned WHERE {kind}_bin IS NOT NULL GROUP BY tool, {kind}_bin, prob)
              WINDOW w AS (PARTITION BY tool, bin ORDER BY prob DESC ROWS UNBOUNDED PRECEDING),
                     g AS (PARTITION BY tool, bin))
        WHERE p > 0 AND n > 0
    """


_SWEEP_COLUMNS = ("precision", "recall", "f1", "accuracy", "tpr", "fpr", "youden")


def _rounded(columns, digits: int = 6) -> str:
    return ", ".join(f"ROUND({c}, {digits}) AS {c}" for c in columns)


TRAINED = ", ".join(f"{name} AS MATERIALIZED ({sql})" for name, sql in training_sql()) + ", epochs AS (" + " UNION ALL ".join(
    f"SELECT * FROM e{e}" for e in range(1, TRAIN_EPOCHS + 1)
) + ")"

# query -> (parts it needs, SQL)
PILEUP = """
        SELECT key, dp AS "DP", ad AS "AD", ROUND(COALESCE(ad / NULLIF(dp, 0), 0), 6) AS "VAF",
               ROUND(mq / GREATEST(ad, 1), 6) AS "MQ", ROUND(ABS(ad - 2 * rev) / GREATEST(ad, 1), 6) AS "SB"
        FROM (SELECT key, COUNT(l_partkey) AS dp,
                     COUNT(*) FILTER (WHERE SUBSTR('ACGT', CAST(l_orderkey % 4 + 1 AS INT), 1) = alt) AS ad,
                     COALESCE(SUM(l_orderkey % 60) FILTER
                       (WHERE SUBSTR('ACGT', CAST(l_orderkey % 4 + 1 AS INT), 1) = alt), 0) AS mq,
                     COUNT(*) FILTER (WHERE SUBSTR('ACGT', CAST(l_orderkey % 4 + 1 AS INT), 1) = alt
                       AND l_linestatus = 'F') AS rev
              FROM sites LEFT JOIN lineitem ON chrom = l_suppkey % 22 AND l_partkey <= pos0
                AND pos0 < l_partkey + CAST(l_quantity AS BIGINT)
              GROUP BY key)
        """
PARTS["paired_reads"] = (
    (),
    """
    SELECT *, COUNT(*) OVER (PARTITION BY chrom, name) AS n,
           ROW_NUMBER() OVER (PARTITION BY chrom, name ORDER BY s, e, mate) AS m
    FROM (SELECT 1 AS mate, l_suppkey % 22 AS chrom, CONCAT_WS(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS name,
                 l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e, NULL AS gap,
                 SUBSTR('ACGT', CAST(l_orderkey % 4 + 1 AS INT), 1) AS letter, 10 + l_linenumber AS quality,
                 l_orderkey % 60 AS mapq, 0 AS rev
          FROM lineitem WHERE l_orderkey % 20 <> 0
          UNION ALL
          SELECT 2, l_suppkey % 22, CONCAT_WS(':', l_orderkey, l_linenumber, l_partkey, l_suppkey),
                 l_partkey + CAST(l_quantity AS BIGINT) // 3, l_partkey + CAST(l_quantity AS BIGINT) // 3 + CAST(l_quantity AS BIGINT) + 2,
                 l_partkey + CAST(l_quantity AS BIGINT) // 3 + GREATEST(1, CAST(l_quantity AS BIGINT) // 2),
                 SUBSTR('ACGT', CAST((l_orderkey + l_suppkey % 2) % 4 + 1 AS INT), 1), 10 + l_partkey % 7, l_orderkey % 60, 1
          FROM lineitem)
    """,
)
PARTS["over_paired"] = (
    ("sites", "paired_reads"),
    """
    SELECT *, n <> 2 OR ROW_NUMBER() OVER (PARTITION BY key, name ORDER BY q DESC, m) = 1 AS stays
    FROM (SELECT key, alt, name, letter, mapq, rev, n, m, p.s IS NOT NULL AS found, gone,
                 CASE WHEN gone THEN -1 ELSE quality END AS q
          FROM (SELECT sites.key, alt, r.*, COALESCE(pos0 BETWEEN gap AND gap + 1, FALSE) AS gone
                FROM sites LEFT JOIN paired_reads r ON r.chrom = sites.chrom AND r.s <= pos0 AND pos0 < r.e) p)
    """,
)
PILEUP_PAIRED = """
    SELECT key, dp AS "DP", ad AS "AD", ROUND(COALESCE(ad / NULLIF(dp, 0), 0), 6) AS "VAF",
           ROUND(mq / GREATEST(ad, 1), 6) AS "MQ", ROUND(ABS(ad - 2 * rev) / GREATEST(ad, 1), 6) AS "SB"
    FROM (SELECT key, COUNT(*) FILTER (WHERE found AND {kept}) AS dp, COUNT(*) FILTER (WHERE hit AND {kept}) AS ad,
                 COALESCE(SUM(mapq) FILTER (WHERE hit AND {kept}), 0) AS mq, COUNT(*) FILTER (WHERE hit AND {kept} AND rev = 1) AS rev
          FROM (SELECT *, found AND NOT gone AND letter = alt AND q >= 13 AS hit FROM over_paired) GROUP BY key)
"""

QUERIES: dict[str, tuple[tuple[str, ...], str]] = {
    "normalize_key": (
        ("variants",),
        "SELECT SUBSTR(chrom, 4) AS chrom, CAST(pos AS VARCHAR) AS pos, UPPER(ref) AS ref, "
        "SPLIT_PART(alt, ',', 1) AS alt FROM variants",
    ),
    "variant_key": (("keyed",), "SELECT key, label FROM keyed"),
    "split_key": (
        ("keyed",),
        "SELECT SPLIT_PART(key, ':', 1) AS chrom, CAST(SPLIT_PART(key, ':', 2) AS BIGINT) AS pos, "
        "SPLIT_PART(key, ':', 3) AS ref, SPLIT_PART(key, ':', 4) AS alt FROM keyed",
    ),
    "explode_alts": (
        ("variants",),
        "SELECT chrom, pos, ref, UNNEST(STRING_SPLIT(alt, ',')) AS alt FROM variants",
    ),
    "site_windows": (
        ("variants",),
        f"SELECT SUBSTR(chrom, 4) AS chrom, GREATEST(pos - 1 - {WINDOW_RADIUS}, 0) AS start, "
        f"pos + {WINDOW_RADIUS} AS \"end\", CONCAT(SUBSTR(chrom, 4), ':', pos, ':', ref, ':', alt) AS key FROM variants",
    ),
    "merge_label": (
        ("variants",),
        "SELECT chrom, pos, ref, alt, label, src_rank FROM variants",
    ),
    "truth_load": (("keyed",), "SELECT key, MIN(label) AS label FROM keyed GROUP BY key"),
    "first_per_key": (
        ("keyed",),
        "SELECT key, label FROM keyed QUALIFY ROW_NUMBER() OVER (PARTITION BY key ORDER BY src_rank, label) = 1",
    ),
    "coerce_clip": (
        ("raw",),
        "SELECT id, rn, CASE WHEN TRY_CAST(tlod AS DOUBLE) IS NOT NULL THEN "
        "LEAST(50000e0, GREATEST(1000e0, TRY_CAST(tlod AS DOUBLE))) END AS clipped FROM raw",
    ),
    "minmax_scale": (
        ("raw",),
        "SELECT id, rn, tlod, ROUND((TRY_CAST(tlod AS DOUBLE) - low) / (high - low), 6) AS scaled FROM raw, "
        "(SELECT MIN(TRY_CAST(tlod AS DOUBLE)) AS low, MAX(TRY_CAST(tlod AS DOUBLE)) AS high FROM raw)",
    ),
    "allele_fraction": (
        ("raw",),
        "SELECT id, rn, ROUND(t_alt_count / NULLIF(t_ref_count + t_alt_count, 0), 6) AS vaf, "
        "CAST(t_ref_count + t_alt_count AS DOUBLE) AS depth FROM raw",
    ),
    "allele_fraction_ad": (
        ("raw",),
        "SELECT id, rn, ROUND(CAST(SPLIT_PART(ad, ',', 2) AS DOUBLE) / NULLIF(CAST(SPLIT_PART(ad, ',', 1) AS DOUBLE) "
        "+ CAST(SPLIT_PART(ad, ',', 2) AS DOUBLE), 0), 6) AS vaf FROM raw",
    ),
    "qual_logistic": (("raw",), "SELECT id, rn, ROUND(1 / (1 + EXP(-qual / 10e0)), 6) AS score FROM raw"),
    "score_chain": (
        ("raw",),
        """
        SELECT 'tlod' AS link, id, rn,
               ROUND(COALESCE((TRY_CAST(tlod AS DOUBLE) - low) / (high - low), 0), 6) AS prob
        FROM raw, (SELECT MIN(TRY_CAST(tlod AS DOUBLE)) AS low, MAX(TRY_CAST(tlod AS DOUBLE)) AS high FROM raw)
        UNION ALL
        SELECT 'af', id, rn, ROUND(CAST(SPLIT_PART(ad, ',', 2) AS DOUBLE) / (CAST(SPLIT_PART(ad, ',', 1) AS DOUBLE) +
               CAST(SPLIT_PART(ad, ',', 2) AS DOUBLE)), 6) FROM raw
        UNION ALL
        SELECT 'qual', id, rn, ROUND(1 / (1 + EXP(-qual / 10e0)), 6) FROM raw
        """,
    ),
    "score_fallback": (
        ("raw",),
        "SELECT id, rn, CASE WHEN filter = 'PASS' THEN 1e0 ELSE 0.5e0 END AS prob FROM raw",
    ),
    "info_score": (
        (),
        """
        SELECT event_id, CASE WHEN event_type = 'view' THEN CAST(user_id AS DOUBLE) ELSE v END AS strict_score,
               CASE event_type WHEN 'view' THEN CAST(user_id AS DOUBLE) WHEN 'error' THEN 0.2e0 ELSE v END
                 AS loose_score
        FROM (SELECT *, CAST(CAST(FLOOR(value * 100) AS BIGINT) AS DOUBLE) AS v FROM events)
        """,
    ),
    "maf_scan": (
        ("variants",),
        "SELECT REGEXP_REPLACE(chrom, '^chr', '') AS chrom, pos, ref, alt, 0 AS label, 'negative' AS source, 0 AS src_rank "
        "FROM variants WHERE pos % 5 <> 0",
    ),
    "truth_vcf_scan": (
        ("variants",),
        "SELECT REGEXP_REPLACE(chrom, '^chr', '') AS chrom, pos, ref, UNNEST(STRING_SPLIT(alt, ',')) AS alt, 1 AS label, "
        "'positive' AS source, 1 AS src_rank FROM variants",
    ),
    "good_calls": (
        ("raw",),
        """
        SELECT CAST(id % 22 AS VARCHAR) AS chrom, CAST(rn AS BIGINT) AS pos, 'A' AS ref, 'C' AS alt, CAST(tlod AS DOUBLE) AS score
        FROM raw WHERE id % 13 <> 0 AND id % 17 <> 0 AND tlod <> 'x'
        UNION ALL
        SELECT CAST(id % 22 AS VARCHAR), CAST(rn AS BIGINT), 'A', 'G', CAST(rn AS DOUBLE)
        FROM raw WHERE id % 13 <> 0 AND id % 17 <> 0 AND tlod <> 'x' AND id % 3 = 0
        """,
    ),
    "fasta_chunks": (
        (),
        f"""
        SELECT contig, k AS chunk_id, SUBSTR(letters, CAST(k * 256 + 1 AS INT), {256 + 2 * SEQUENCE_RADIUS + 1}) AS text
        FROM (SELECT contig, letters, UNNEST(RANGE(CAST(CEIL(LENGTH(letters) / 256e0) AS BIGINT))) AS k
              FROM (SELECT CAST(doc_id AS VARCHAR) AS contig,
                           ARRAY_TO_STRING(LIST_TRANSFORM(STRING_SPLIT(text, chr(10)), lambda x: TRIM(x, ' ')), '') AS letters
                    FROM documents))
        """,
    ),
    "linear_scores": (
        (),
        "SELECT vec_id, ROUND(1 / (1 + EXP(-s)), 6) AS prob FROM (SELECT vec_id, SUM(CAST(x AS DOUBLE) * ((k * 37 % 11 - 5) / 1e1)) "
        "AS s FROM (SELECT vec_id, UNNEST(RANGE(64)) AS k, UNNEST(embedding) AS x FROM embeddings) GROUP BY vec_id)",
    ),
    "quarantine": (
        ("raw",),
        """
        SELECT reason, line, COUNT(*) AS n_rows FROM (
          SELECT CASE WHEN id % 13 = 0 THEN 'short line' WHEN id % 17 = 0 THEN 'position is not a number'
                      WHEN tlod = 'x' THEN 'score is not a number' END AS reason,
                 CONCAT('chr', id % 22, chr(9), CASE WHEN id % 17 = 0 THEN 'p' ELSE CAST(rn AS VARCHAR) END, chr(9), '.',
                        chr(9), 'A', chr(9), CASE WHEN id % 3 = 0 THEN 'C,G' ELSE 'C' END,
                        CASE WHEN id % 13 = 0 THEN '' ELSE CONCAT(chr(9), '.', chr(9), filter, chr(9), 'AF=', tlod,
                             CASE WHEN id % 3 = 0 THEN CONCAT(',', rn) ELSE '' END) END) AS line
          FROM raw) WHERE reason IS NOT NULL GROUP BY ALL
        """,
    ),
    "annotations": (
        ("raw",),
        """
        SELECT key, ROUND(vaf_est, 6) AS vaf_est, ROUND(depth_est, 6) AS depth_est FROM (
          SELECT CAST(event_id AS VARCHAR) AS key, LEAST(1e0, GREATEST(0e0, value / 1000)) AS vaf_est,
                 CAST(NULL AS DOUBLE) AS depth_est, 0 AS src_rank, 0 AS rn FROM events
          UNION ALL
          SELECT CAST(id AS VARCHAR), t_alt_count / NULLIF(t_ref_count + t_alt_count, 0),
                 CAST(t_ref_count + t_alt_count AS DOUBLE), 1, rn FROM raw)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY key ORDER BY src_rank, rn, depth_est, vaf_est) = 1
        """,
    ),
    "align_universe": (("scored",), "SELECT key, label, prob, tool FROM scored"),
    "max_per_key": (("calls",), "SELECT tool, key, MAX(prob) AS prob FROM calls GROUP BY tool, key"),
    "clean_by_key": (
        ("calls", "truth"),
        "SELECT key, MAX(prob) AS prob, ANY_VALUE(label) AS label FROM calls JOIN truth USING (key) GROUP BY key",
    ),
    "label_calls": (
        ("calls",),
        "SELECT key, tool, MIN(prob) AS prob, ANY_VALUE(CASE WHEN o_orderstatus <> 'P' THEN "
        "CAST(o_orderstatus = 'F' AS INT) END) AS label FROM calls "
        "LEFT JOIN orders ON CAST(o_orderkey AS VARCHAR) = key GROUP BY key, tool",
    ),
    "paired_scores": (
        ("scored",),
        "SELECT a.key, a.label, a.prob AS prob_a, b.prob AS prob_b FROM scored a JOIN scored b ON a.key = b.key "
        "WHERE a.tool = 'model' AND b.tool = 'caller_1'",
    ),
    "cyclic_zip": (
        (),
        "SELECT event_id AS index, CAST(event_type = 'error' AS INT) AS label, value, p_brand, p_size FROM events "
        "JOIN part ON p_partkey = event_id % (SELECT COUNT(*) FROM part)",
    ),
    "drop_unlabelled": (
        (),
        "SELECT doc_id, n_chars, lang, quality AS label FROM documents JOIN labels USING (doc_id)",
    ),
    "qc_merge": (("evidence",), 'SELECT key, ' + _rounded(('"DP"', '"AD"', '"VAF"', '"MQ"', '"SB"', '"MAP"', '"RTIM"')) + " FROM evidence"),
    "feature_join": (
        ("featured",),
        "SELECT key, l_orderkey, l_linenumber, "
        + _rounded(('"DP"', '"AD"', '"VAF"', '"MQ"', '"SB"', '"MAP"', '"RTIM"'))
        + " FROM featured",
    ),
    "qc_vector": (
        ("featured",),
        "SELECT l_orderkey, l_linenumber, CONCAT_WS(',', "
        + ", ".join(
            f'CAST(FLOOR(CAST(CAST("{c}" AS FLOAT) AS DOUBLE) * 100 + 0.5) AS BIGINT)'
            for c in ("DP", "AD", "VAF", "MQ", "SB", "MAP", "RTIM")
        )
        + ") AS qc FROM featured",
    ),
    "calls_only_in_a": (("masks",), "SELECT key FROM masks WHERE mask & 3 = 1"),
    "calls_in_both": (("masks",), "SELECT key FROM masks WHERE mask & 3 = 3"),
    "pileup_qc": (("sites",), PILEUP),
    "pileup_regions": (("sites",), PILEUP),
    "pileup_gaps": (("over_paired",), PILEUP_PAIRED.format(kept="TRUE")),
    "pileup_mates": (("over_paired",), PILEUP_PAIRED.format(kept="stays")),
    "batch_scores": (
        (),
        "SELECT ROW_NUMBER() OVER (ORDER BY vec_id) - 1 AS row, vec_id, ROUND(1 / (1 + EXP(-s)), 6) AS prob FROM "
        "(SELECT vec_id, SUM(CAST(x AS DOUBLE) * ((k * 37 % 11 - 5) / 1e1)) "
        "AS s FROM (SELECT vec_id, UNNEST(RANGE(64)) AS k, UNNEST(embedding) AS x FROM embeddings) GROUP BY vec_id)",
    ),
    "window_signal": (
        ("sites",),
        f"""
        SELECT key, ANY_VALUE(e - s) AS size, CAST(COALESCE(SUM(o), 0) AS BIGINT) AS covered,
               CAST(COALESCE(SUM(o * value), 0) AS DOUBLE) AS sum,
               ROUND(COALESCE(SUM(o * value) / NULLIF(SUM(o), 0), 0), 6) AS mean
        FROM (SELECT key, s, e, o_custkey AS value, LEAST(e, o_orderkey + 3) - GREATEST(s, o_orderkey) AS o
              FROM (SELECT key, chrom, GREATEST(pos0 - {WINDOW_RADIUS}, 0) AS s, pos0 + 1 + {WINDOW_RADIUS} AS e
                    FROM sites)
              LEFT JOIN orders ON chrom = o_custkey % 22 AND o_orderkey < e AND o_orderkey + 3 > s)
        GROUP BY key
        """,
    ),
    "seq_window": (("cut",), "SELECT site, contig, pos, seq FROM cut"),
    "one_hot": (
        ("cut",),
        "SELECT site, " + ", ".join(f"{_one_hot(b)} AS channel_{b.lower()}" for b in "ACGT") + " FROM cut",
    ),
    "epoch_metrics": (
        (),
        f"WITH {TRAINED} SELECT epoch, "
        + ", ".join(f"ROUND({c}, 6) AS {c}" for c in ("train_loss", "valid_loss", "auroc", "average_precision"))
        + ", epoch = (SELECT ARG_MAX(epoch, auroc) FROM epochs) AS best FROM epochs",
    ),
    "epoch_scores": (
        (),
        f"WITH {TRAINED}, kept AS (SELECT * FROM ("
        + " UNION ALL ".join(f"SELECT {e} AS epoch, * FROM c{e * TRAIN_BATCHES}" for e in range(1, TRAIN_EPOCHS + 1))
        + ") WHERE epoch = (SELECT ARG_MAX(epoch, auroc) FROM epochs)) "
        "SELECT key, CAST(y AS INT) AS label, ROUND(p, 6) AS prob, CAST(p >= 0.5 AS INT) AS pred FROM "
        "(SELECT key, y, ROUND(1 / (1 + EXP(-(c1 * z1 + c2 * z2 + c3 * z3 + c4))), 12) AS p FROM fit_z, kept)",
    ),
    "csv_scan": (("scored",), "SELECT key, label, ROUND(prob, 6) AS prob, tool FROM scored"),
    "prediction_scan": (
        ("model",),
        "SELECT CAST(key AS BIGINT) AS index, label, ROUND(prob, 6) AS prob, CAST(prob >= 0.5 AS INT) AS pred_05 FROM model",
    ),
    "keyed_scan": (("model",), "SELECT key, CASE WHEN key NOT LIKE '%7' THEN ROUND(prob, 6) END AS prob FROM model"),
    "bed_lines": (
        ("variants",),
        f"SELECT CONCAT_WS(chr(9), SUBSTR(chrom, 4), GREATEST(pos - 1 - {WINDOW_RADIUS}, 0), pos + {WINDOW_RADIUS}, "
        "CONCAT(SUBSTR(chrom, 4), ':', pos, ':', ref, ':', alt)) AS value FROM variants",
    ),
    "metric_lines": (
        ("confusion",),
        "SELECT UNNEST([CONCAT('TP=', tp), CONCAT('FP=', fp), CONCAT('TN=', tn), CONCAT('FN=', fn), "
        "CONCAT('PRECISION=', PRINTF('%.6f', CAST(tp AS DOUBLE) / (tp + fp))), "
        "CONCAT('RECALL=', PRINTF('%.6f', CAST(tp AS DOUBLE) / (tp + fn)))]) AS value FROM confusion WHERE tool = 'model'",
    ),
    "column_synonyms": (("variants",), "SELECT chrom, pos, ref, alt, label FROM variants"),
    "second_chain": (
        ("raw",),
        "SELECT 'qual' AS link, id, rn, ROUND(1 / (1 + EXP(-qual / 10e0)), 6) AS prob FROM raw "
        "UNION ALL SELECT 'half', id, rn, CASE WHEN filter = 'PASS' THEN 1e0 ELSE 5e-1 END FROM raw",
    ),
    "transpose_array": (
        (),
        "SELECT vec_id, CAST(k % 8 AS INT) AS i, CAST(k // 8 AS INT) AS j, ROUND(CAST(x AS DOUBLE), 6) AS x FROM "
        "(SELECT vec_id, UNNEST(RANGE(64)) AS k, UNNEST(embedding) AS x FROM embeddings)",
    ),
    "class_weights": (
        ("scored",),
        "SELECT tool, key, label, ROUND(1e0 / COUNT(*) OVER (PARTITION BY tool, label), 9) AS weight FROM scored",
    ),
    "fixed_bins": (
        ("noted",),
        "SELECT tool, vaf_bin, COUNT(*) AS n_rows, CAST(SUM(label) AS BIGINT) AS positives FROM noted GROUP BY ALL",
    ),
    "quantile_bins": (
        ("binned",),
        "SELECT tool, depth_bin, COUNT(*) AS n_rows, CAST(SUM(label) AS BIGINT) AS positives FROM binned GROUP BY ALL",
    ),
    "stratified_pr_points": (
        ("binned",),
        "SELECT tool, stratum, bin, CASE WHEN threshold >= 0 THEN threshold END AS threshold, precision, recall FROM "
        f"({_strata_points('vaf')} UNION ALL {_strata_points('depth')}) WHERE recall IS NOT NULL",
    ),
    "stratified_pr": (("binned",), _strata("vaf") + " UNION ALL " + _strata("depth")),
    "class_counts": (
        ("scored",),
        "SELECT tool, COUNT(*) AS n_rows, CAST(SUM(label) AS BIGINT) AS positives, CAST(SUM(1 - label) AS BIGINT) "
        "AS negatives, CAST(0 AS BIGINT) AS unlabelled, ROUND(AVG(label), 6) AS positive_rate FROM scored GROUP BY tool",
    ),
    "hard_calls": (
        ("scored",),
        "SELECT key, label, ROUND(prob, 6) AS prob, tool, CAST(prob >= 0.5 AS INT) AS pred FROM scored",
    ),
    "confusion_counts": (("confusion",), "SELECT * FROM confusion"),
    "threshold_metrics": (
        ("confusion",),
        """
        SELECT *, ROUND(COALESCE(tp / NULLIF(tp + fp, 0), 0), 6) AS precision,
               ROUND(COALESCE(tp / NULLIF(tp + fn, 0), 0), 6) AS recall,
               ROUND(COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), 6) AS f1,
               ROUND(COALESCE(tn / NULLIF(tn + fp, 0), 0), 6) AS specificity,
               ROUND((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy FROM confusion
        """,
    ),
    "class_report": (
        ("confusion",),
        """
        WITH one AS (
          SELECT tool, '0' AS class, COALESCE(tn / NULLIF(tn + fn, 0), 0) AS precision,
                 COALESCE(tn / NULLIF(tn + fp, 0), 0) AS recall,
                 COALESCE(2 * tn / NULLIF(2 * tn + fp + fn, 0), 0) AS f1, tn + fp AS support FROM confusion
          UNION ALL
          SELECT tool, '1', COALESCE(tp / NULLIF(tp + fp, 0), 0), COALESCE(tp / NULLIF(tp + fn, 0), 0),
                 COALESCE(2 * tp / NULLIF(2 * tp + fp + fn, 0), 0), tp + fn FROM confusion)
        SELECT tool, class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1,
               CAST(support AS BIGINT) AS support
        FROM (SELECT * FROM one
              UNION ALL
              SELECT tool, 'macro avg', AVG(precision), AVG(recall), AVG(f1), SUM(support) FROM one GROUP BY tool
              UNION ALL
              SELECT tool, 'weighted avg', SUM(precision * support) / SUM(support),
                     SUM(recall * support) / SUM(support), SUM(f1 * support) / SUM(support), SUM(support)
              FROM one GROUP BY tool
              UNION ALL
              SELECT tool, 'accuracy', (tp + tn) / (tp + tn + fp + fn), (tp + tn) / (tp + tn + fp + fn),
                     (tp + tn) / (tp + tn + fp + fn), tp + tn + fp + fn FROM confusion)
        """,
    ),
    "confusion_norm": (
        ("scored",),
        "SELECT tool, label, pred, n_rows, ROUND(n_rows / SUM(n_rows) OVER (PARTITION BY tool, label), 6) AS share "
        "FROM (SELECT tool, label, CAST(prob >= 0.5 AS INT) AS pred, COUNT(*) AS n_rows FROM scored GROUP BY ALL)",
    ),
    "brier": (
        ("scored",),
        "SELECT tool, ROUND(AVG((prob - label) * (prob - label)), 6) AS brier FROM scored GROUP BY tool",
    ),
    "metrics_table": (("metrics",), "SELECT * FROM metrics"),
    "single_class": (("four_metrics",), "SELECT * FROM four_metrics"),
    "report_rows": (
        ("four_metrics",),
        "SELECT tool, CONCAT_WS(' | ', tool, "
        + ", ".join(
            f"COALESCE(FORMAT('{{:.3f}}', {c}), '')"
            for c in ("auroc", "auprc", "f1", "precision", "recall", "specificity", "prec_at_r95", "rec_at_p90")
        )
        + ") AS line FROM four_metrics",
    ),
    "roc_curve": (
        ("points",),
        "SELECT tool, ROUND(score, 6) AS threshold, ROUND(fp / n, 6) AS fpr, ROUND(tp / p, 6) AS tpr FROM points "
        "UNION ALL SELECT DISTINCT tool, NULL, 0e0, 0e0 FROM points",
    ),
    "pr_curve": (
        ("pr",),
        "SELECT tool, ROUND(score, 6) AS threshold, ROUND(prec, 6) AS precision, ROUND(rec, 6) AS recall FROM pr "
        "UNION ALL SELECT DISTINCT tool, NULL, 1e0, 0e0 FROM pr",
    ),
    "auroc": (
        ("points",),
        "SELECT tool, ROUND(CAST(SUM(neg * (2 * tp - pos)) AS DOUBLE) / (2e0 * MAX(p) * MAX(n)), 6) AS auroc "
        "FROM points GROUP BY tool",
    ),
    "auprc": (("pr",), "SELECT tool, ROUND(SUM(pos / p * (prec + prior_prec) / 2), 6) AS auprc FROM pr GROUP BY tool"),
    "average_precision": (
        ("pr",),
        "SELECT tool, ROUND(SUM(pos / p * prec), 6) AS average_precision FROM pr GROUP BY tool",
    ),
    "prec_at_recall": (
        ("pr",),
        "SELECT tool, ROUND(prec, 6) AS precision, ROUND(score, 6) AS threshold FROM pr WHERE rec >= 0.95 "
        "QUALIFY ROW_NUMBER() OVER (PARTITION BY tool ORDER BY prec DESC, score) = 1",
    ),
    "rec_at_precision": (
        ("pr",),
        "SELECT tool, ROUND(COALESCE(MAX(rec) FILTER (WHERE prec >= 0.90), 0), 6) AS recall, "
        "ROUND(MIN(score) FILTER (WHERE prec >= 0.90), 6) AS threshold FROM pr GROUP BY tool",
    ),
    "operating_points": (("pr", "points"), _operating(False)),
    "operating_points_reference": (("pr", "points"), _operating(True)),
    "threshold_sweep": (
        ("sweep",),
        f"SELECT tool, ROUND(threshold, 6) AS threshold, tp, fp, tn, fn, {_rounded(_SWEEP_COLUMNS)} FROM sweep",
    ),
    "best_thresholds": (
        ("sweep",),
        f"SELECT tool, criterion, ROUND(threshold, 6) AS threshold, {_rounded(_SWEEP_COLUMNS)} FROM "
        f"({_best('f1')} UNION ALL {_best('youden')})",
    ),
    "best_f1_grid": (
        ("scored",),
        """
        SELECT tool, ROUND(threshold, 6) AS threshold, ROUND(f1, 6) AS f1 FROM (
          SELECT tool, i * 5 / 1e2 AS threshold,
                 2 * SUM(CAST(prob >= i * 5 / 1e2 AS INT) * label) /
                   (SUM(CAST(prob >= i * 5 / 1e2 AS INT)) + SUM(label)) AS f1
          FROM scored, RANGE(1, 20) g(i) GROUP BY tool, i)
        QUALIFY ROW_NUMBER() OVER (PARTITION BY tool ORDER BY f1 DESC, threshold) = 1
        """,
    ),
    "calibration": (
        ("scored",),
        """
        SELECT tool, bin, COUNT(*) AS n_rows, ROUND(AVG(prob), 6) AS mean_score, ROUND(AVG(label), 6) AS positive_rate
        FROM (SELECT s.tool, label, prob, CAST(LEN(LIST_FILTER(edges, lambda e: e < prob)) AS INT) AS bin
              FROM scored s JOIN (SELECT tool, QUANTILE_CONT(prob, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS edges
                                  FROM scored GROUP BY tool) q ON q.tool = s.tool)
        GROUP BY tool, bin
        """,
    ),
    "score_summary": (
        ("scored", "box"),
        """
        SELECT tool, label, ANY_VALUE(n_rows) AS n_rows, ROUND(ANY_VALUE(mean), 6) AS mean,
               ROUND(ANY_VALUE(lowest), 6) AS lowest, ROUND(ANY_VALUE(q1), 6) AS q1,
               ROUND(ANY_VALUE(median), 6) AS median, ROUND(ANY_VALUE(q3), 6) AS q3,
               ROUND(ANY_VALUE(highest), 6) AS highest,
               ROUND(MIN(prob) FILTER (WHERE prob >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_low,
               ROUND(MAX(prob) FILTER (WHERE prob <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_high
        FROM scored JOIN box USING (tool, label) GROUP BY tool, label
        """,
    ),
    "score_hist": (
        ("scored",),
        """
        SELECT tool, label, bin, n_rows, ROUND(n_rows * 20e0 / SUM(n_rows) OVER (PARTITION BY tool, label), 6) AS density
        FROM (SELECT tool, label, CAST(LEAST(FLOOR(prob * 20), 19) AS INT) AS bin, COUNT(*) AS n_rows
              FROM scored GROUP BY ALL)
        """,
    ),
    "overlap_counts": (
        ("masks",),
        """
        SELECT *, (CAST(s1 > 0 AS INT) + CAST(s2 > 0 AS INT) + CAST(s4 > 0 AS INT) < 2)
               OR GREATEST(s1, s2, s4) / GREATEST(any_tool, 1) > 0.98 AS degenerate
        FROM (SELECT COUNT(*) FILTER (WHERE mask = 1) AS model_only, COUNT(*) FILTER (WHERE mask = 2) AS caller_1_only,
                     COUNT(*) FILTER (WHERE mask = 4) AS caller_2_only,
                     COUNT(*) FILTER (WHERE mask = 3) AS model_and_caller_1_only,
                     COUNT(*) FILTER (WHERE mask = 5) AS model_and_caller_2_only,
                     COUNT(*) FILTER (WHERE mask = 6) AS caller_1_and_caller_2_only,
                     COUNT(*) FILTER (WHERE mask = 7) AS all_three, COUNT(*) AS any_tool,
                     COUNT(*) FILTER (WHERE mask & 1 > 0) AS s1, COUNT(*) FILTER (WHERE mask & 2 > 0) AS s2,
                     COUNT(*) FILTER (WHERE mask & 4 > 0) AS s4 FROM masks)
        """.replace("SELECT *, (", "SELECT * EXCLUDE (s1, s2, s4), ("),
    ),
    "overlap_regions": (
        ("masks",),
        "SELECT mask, CONCAT_WS('&', CASE WHEN mask & 1 > 0 THEN 'model' END, CASE WHEN mask & 2 > 0 THEN 'caller_1' END, "
        "CASE WHEN mask & 4 > 0 THEN 'caller_2' END) AS tools, COUNT(*) AS keys FROM masks GROUP BY mask",
    ),
    "top_errors": (
        ("errs",),
        "SELECT tool, err, CAST(rank AS INT) AS rank, key, key AS chrom, CAST(NULL AS BIGINT) AS pos, "
        "CAST(NULL AS VARCHAR) AS ref, CAST(NULL AS VARCHAR) AS alt, ROUND(prob, 6) AS prob, label FROM errs",
    ),
    "loci_list": (
        ("keyed",),
        """
        SELECT 'model' AS tool, CASE WHEN label = 0 THEN 'FP' ELSE 'FN' END AS err, CAST(rank AS INT) AS rank,
               CONCAT(SPLIT_PART(key, ':', 1), ':', SPLIT_PART(key, ':', 2), '-', SPLIT_PART(key, ':', 2)) AS locus
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY
                CASE WHEN label = 0 THEN -score ELSE score END, key) AS rank
              FROM (SELECT key, MAX(label) AS label, MAX(pos * 7919 % 1000) AS score FROM keyed GROUP BY key))
        WHERE rank <= 20
        """,
    ),
    "hash_split": (
        ("split_draw",),
        f"SELECT key, label, ROUND(prob, 6) AS prob, tool, CASE WHEN u / {float(DRAW_RANGE)} < 0.8 THEN 'train' "
        "ELSE 'validation' END AS split FROM split_draw",
    ),
    "balanced_sample": (
        ("balanced_draws", "classes"),
        "SELECT tool, '' AS draw, key, label, prob FROM classes WHERE label = 1 UNION ALL "
        "SELECT d.tool, d.key, c.key, c.label, c.prob FROM balanced_draws d JOIN classes c ON c.tool = d.tool "
        "AND c.label = 0 AND c.idx = d.idx",
    ),
    "weighted_resample": (
        ("weighted_draws", "classes"),
        "SELECT d.tool, d.key AS draw, c.key, c.label, c.prob FROM weighted_draws d JOIN classes c ON c.tool = d.tool "
        "AND c.label = d.label AND c.idx = d.idx",
    ),
    "bootstrap_auroc": (
        ("boot",),
        f"SELECT tool, {interval_sql('auroc')}, COUNT(*) FILTER (WHERE rep >= 0) AS reps_used FROM boot GROUP BY tool",
    ),
    "bootstrap_auprc": (
        ("boot",),
        f"SELECT tool, {interval_sql('auprc')}, COUNT(*) FILTER (WHERE rep >= 0) AS reps_used FROM boot GROUP BY tool",
    ),
    "bootstrap_stratified": (
        ("stratified_boot",),
        f"SELECT tool, {interval_sql('auroc')}, COUNT(*) FILTER (WHERE rep >= 0) AS reps_used "
        "FROM stratified_boot GROUP BY tool",
    ),
    "bootstrap_delta": (
        ("boot",),
        f"SELECT 'model' AS tool_a, tool_b, {interval_sql('delta_auroc')}, {interval_sql('delta_auprc')}, "
        "COUNT(*) FILTER (WHERE rep >= 0) AS reps_used FROM (SELECT rep, b.tool AS tool_b, a.auroc - b.auroc AS delta_auroc, "
        "a.auprc - b.auprc AS delta_auprc FROM boot a JOIN boot b USING (rep) "
        "WHERE a.tool = 'model' AND b.tool <> 'model') GROUP BY tool_b",
    ),
}


QUERIES["signal_scan"] = QUERIES["window_signal"]


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        _needed(PARTS[name][0], seen)
        if name not in seen:
            seen.append(name)
    return seen


def oracle_sql() -> dict[str, str]:
    """Each query as one statement, its views spelled out as common table expressions."""
    result = {}
    for query, (needs, sql) in QUERIES.items():
        parts = [f"{name} AS ({PARTS[name][1]})" for name in _needed(needs, [])]
        if not parts:
            result[query] = sql
        elif sql.lstrip().upper().startswith("WITH "):
            result[query] = f"WITH {', '.join(parts)}, {sql.lstrip()[5:]}"
        else:
            result[query] = f"WITH {', '.join(parts)} {sql}"
    return result
