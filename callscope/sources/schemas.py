"""Schemas of the tables that travel between steps."""

from __future__ import annotations

VARIANTS = "chrom string, pos bigint, ref string, alt string, label int, source string, src_rank int"
WINDOWS = "chrom string, start bigint, end bigint, key string"
EVIDENCE = "key string, DP double, AD double, VAF double, MQ double, SB double"
SIGNAL = "key string, size bigint, covered bigint, sum double, mean double"
PREDICTIONS = "index bigint, label int, prob double, `pred_0.5` int"
READS = (
    "chrom string, start bigint, end bigint, cigar array<struct<op:string,len:int>>, seq string, "
    "quals array<int>, mapq int, is_reverse boolean, flag int"
)
