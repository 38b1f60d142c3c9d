"""An outer join that splits hot keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows (one in so many) is split into parts of that share.
PARTS = 4096


def left_join(left: DataFrame, right: DataFrame, on: Sequence[str], parts: int = PARTS) -> DataFrame:
    """``left.join(right, on, "left")`` for a long left side with hot keys and a right side of about one row a key.

    Rows of the left side are counted per key. Fewer than ``parts`` keys can have more than one in
    ``parts`` of all rows, so the table of these keys is broadcast; their rows are dealt to as many salts as
    they hold shares, and their rows of the right side are repeated, fewer than ``2 * parts`` times in
    all where keys are unique there. Rows without a key match nothing and are spread out. Rows that are equal in
    every column stay together.
    """
    on = list(on)
    counted = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows"))
    total = counted.agg(F.sum("_rows")).scalar()
    share = F.col("_rows") * parts / total
    heavy = F.broadcast(counted.filter(share > 1).select(*on, F.ceil(share).cast("int").alias("_parts")))
    no_key = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    # Maps cannot be hashed; they decide nothing here.
    hashed = [f.name for f in left.schema if "map<" not in f.dataType.simpleString()]
    own = F.coalesce("_parts", F.when(no_key, F.lit(parts)), F.lit(1))
    dealt = left.withColumn("_row", F.xxhash64(*hashed)).join(heavy, on, "left")
    dealt = dealt.withColumn("_salt", F.pmod("_row", own).cast("int")).drop("_row", "_parts")
    copies = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    spread = right.join(heavy, on, "left").withColumn("_salt", F.explode(copies)).drop("_parts")
    return dealt.join(spread, [*on, "_salt"], "left").drop("_salt")
