"""Windows, read evidence and interval signals: joins on ranges.

A bare range condition makes Spark compare everything with everything. Both joins here cut the
axis into bins, join on (chrom, bin) and check the range afterwards. A bin with many rows is split
into as many parts as its counted rows ask for; other bins are neither split nor repeated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callscope.functions.keys import norm_chrom
from callscope.functions.numeric import ratio_or_zero
from callscope.session import durable

# CIGAR operations, the default mask of reads to skip, the default quality floor.
ALIGNED_OPS = ("M", "=", "X")
REFERENCE_OPS = ("M", "=", "X", "D", "N")
QUERY_OPS = ("M", "=", "X", "I", "S")
SKIP_FLAGS = 0x4 | 0x100 | 0x200 | 0x400
MIN_BASE_QUALITY = 13
WINDOW_RADIUS = 100
# A letter lost to the mate, which is no base.
LOST = "."
# Stands for a letter of low quality or a deletion that is written out, no bases either.
HIDDEN = "\x01"
# Rows of a bin that one task of a range join may hold before the bin is split.
BIN_ROWS = 50_000
# Reads or pieces of reads that one task holds; bins with sites that are sent to all tasks.
TASK_PIECES = 250_000
SENT_BINS = 100_000
# Places that are sent to all tasks, and the bits of a place inside its stretch; a letter takes 21 bits of a packed number beside it.
SENT_PLACES = 20_000_000
PLACE_BITS = 11
# Bits of a stretch's number, which is not above SENT_BINS.
STRETCH_BITS = 20
# Letters as numbers: none, hidden, behind the last one of the read; others follow by code point.
NO_LETTER, HIDDEN_LETTER, BEHIND, FIRST_LETTER = 0, 1, 2, 3


def sites(variants: DataFrame) -> DataFrame:
    """``chrom, pos, ref, alt`` with the chromosome name normalised."""
    return variants.select(norm_chrom("chrom").alias("chrom"), "pos", "ref", "alt")


def site_windows(variants: DataFrame, radius: int = WINDOW_RADIUS) -> DataFrame:
    """0-based half-open windows ``[pos-1-radius, pos+radius)`` with their key, cut at 0."""
    if radius <= 0:
        raise ValueError("radius must be > 0")
    pos = F.col("pos").cast("bigint")
    return variants.select(
        norm_chrom("chrom").alias("chrom"),
        F.greatest(pos - 1 - radius, F.lit(0).cast("bigint")).alias("start"),
        (pos + radius).alias("end"),
        F.concat(norm_chrom("chrom"), F.lit(":"), F.col("pos").cast("string"), F.lit(":"), "ref", F.lit(":"), "alt")
        .alias("key"),
    )


def _bin(offset: Column, width: int) -> Column:
    return F.floor(offset / F.lit(width)).cast("bigint")


def _bins(start: Column, end: Column, width: int) -> Column:
    """Numbers of all bins that ``[start, end)`` touches."""
    return F.explode(F.sequence(_bin(start, width), _bin(end - 1, width)))


def _dealt(
    busy: DataFrame, other: DataFrame, part: Column, rows: int, counted: DataFrame | None = None, key: Sequence[str] = ("chrom", "_bin")
) -> tuple[DataFrame, DataFrame]:
    """Salt a join on ``key``: parts of a bin follow from the counted rows of ``busy`` in it.

    A bin of up to ``rows`` rows is one part and nothing is repeated; a fuller one is split by
    ``part``, and only there ``other`` is repeated. ``counted`` holds the rows ``_n`` of each bin, if known. The full bins are few, at most one for every
    ``rows`` rows; they are broadcast if stored counts say which, else that is left to Spark's check of their size.
    """
    known, key = counted is not None, list(key)
    if not known:
        counted = busy.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    full = counted.filter(F.col("_n") > rows).select(
        *key, (F.floor((F.col("_n") - 1) / rows) + 1).cast("int").alias("_full")
    )
    if known:
        full = F.broadcast(full)
    parts = F.coalesce("_full", F.lit(1))
    split = busy.join(full, key, "left").withColumn("_salt", F.pmod(part, parts).cast("int"))
    spread = other.join(full, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1)))
    return split.drop("_full"), spread.drop("_full")


def _task_count(rows: int, frame: DataFrame) -> int:
    """Tasks for counted rows, so that what one of them holds does not grow with the input."""
    return max(-(-rows // TASK_PIECES), int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def reference_end(start: Column, cigar: Column) -> Column:
    """The place behind the last letter of the reference that a read covers."""
    step = lambda total, item: total + F.when(item["op"].isin(*REFERENCE_OPS), item["len"].cast("bigint")).otherwise(F.lit(0))
    return F.aggregate(cigar, start.cast("bigint"), step)


def _walked(start: Column, cigar: Column) -> Column:
    """The stretches of a read on the reference: array<struct<op,at,offset,len>>."""

    def moves(op: Column, length: Column, ops: tuple[str, ...]) -> Column:
        return F.when(op.isin(*ops), length.cast("bigint")).otherwise(F.lit(0).cast("bigint"))

    begin = F.struct(
        start.cast("bigint").alias("at"),
        F.lit(0).cast("bigint").alias("offset"),
        F.array().cast("array<struct<op:string,at:bigint,offset:bigint,len:bigint>>").alias("done"),
    )

    def step(state: Column, item: Column) -> Column:
        op, length = item["op"], item["len"].cast("bigint")
        block = F.struct(
            op.alias("op"), state["at"].alias("at"), state["offset"].alias("offset"), length.alias("len")
        )
        return F.struct(
            (state["at"] + moves(op, length, REFERENCE_OPS)).alias("at"),
            (state["offset"] + moves(op, length, QUERY_OPS)).alias("offset"),
            F.when(op.isin(*REFERENCE_OPS), F.concat(state["done"], F.array(block)))
            .otherwise(state["done"])
            .alias("done"),
        )

    walked = F.aggregate(cigar, begin, step, lambda state: state["done"])
    # Most reads are one aligned stretch; they skip the walk.
    only = F.get(cigar, F.lit(0))
    single = F.array(
        F.struct(
            only["op"].alias("op"),
            start.cast("bigint").alias("at"),
            F.lit(0).cast("bigint").alias("offset"),
            only["len"].cast("bigint").alias("len"),
        )
    )
    return F.when((F.size(cigar) == 1) & only["op"].isin(*REFERENCE_OPS), single).otherwise(walked)


def aligned_blocks(reads: DataFrame, skip_flags: int = SKIP_FLAGS, keep: Sequence[str] = ()) -> DataFrame:
    """One row per stretch of a read that lies on the reference, with the columns ``keep`` of the read.

    ``reads``: chrom, start (0-based), cigar array<struct<op,len>>, seq, quals, mapq, is_reverse,
    flag. Blocks of deletions and skips have no letters (``seq`` is NULL). The CIGAR is walked with
    array functions inside the JVM.
    """
    kept = reads.filter(F.col("flag").bitwiseAND(F.lit(skip_flags)) == 0)
    walked = _walked(F.col("start"), F.col("cigar"))
    blocks = kept.select("chrom", "seq", "quals", "mapq", "is_reverse", *keep, F.inline(walked))
    aligned = F.col("op").isin(*ALIGNED_OPS)
    first, length = (F.col("offset") + 1).cast("int"), F.col("len").cast("int")
    return blocks.select(
        "chrom",
        F.col("at").alias("start"),
        (F.col("at") + F.col("len")).alias("end"),
        F.when(aligned, F.substr("seq", first, length)).alias("seq"),
        F.when(aligned, F.slice("quals", first, length)).alias("quals"),
        "mapq",
        "is_reverse",
        *keep,
    ).filter(F.col("end") > F.col("start"))


def fragment_blocks(reads: DataFrame, skip_flags: int = SKIP_FLAGS) -> DataFrame:
    """``aligned_blocks`` in which a fragment counts once at every place of the reference.

    Two kept reads of one ``name`` on one chromosome are mates. Where both lie on a place, the letter of the
    higher quality stays, the earlier mate's if they are equal; a deletion loses against any letter and
    missing qualities are equal. What loses becomes ``LOST``, a block without letters as well.
    Reads without a name, and names of one or of more than two reads, stay as they are. Only mates that
    overlap are compared, each block with the blocks of the other read, which a window brings beside it.
    """
    kept = reads.filter(F.col("flag").bitwiseAND(F.lit(skip_flags)) == 0)
    fields = ("chrom", "start", "cigar", "seq", "quals", "mapq", "is_reverse", "flag")
    named = kept.filter(F.col("name").isNotNull()).select(*fields, "name", reference_end(F.col("start"), F.col("cigar")).alias("_e"))
    named = named.repartition(_task_count(kept.filter(F.col("name").isNotNull()).count(), kept), "chrom", "name")
    fragment = Window.partitionBy("chrom", "name")
    first = fragment.orderBy("start", "_e", F.col("flag"), "seq", "mapq", "is_reverse")
    # Both reads of a fragment meet in one shuffle; each takes along what it needs of the other.
    read = F.struct(F.col("start").cast("bigint").alias("start"), "cigar", F.col("seq").isNull().alias("blank"), "quals")
    marked = named.withColumns(
        {
            "_mate": F.row_number().over(first),
            "_n": F.count(F.lit(1)).over(fragment),
            "_meet": F.max("start").over(fragment) < F.min("_e").over(fragment),
            "_o": F.coalesce(F.lag(read).over(first), F.lead(read).over(first)),
        }
    )
    marked = marked.withColumn("_o", F.when((F.col("_n") == 2) & F.col("_meet"), F.col("_o")))
    aligned = lambda b: b["op"].isin(*ALIGNED_OPS)
    other = F.transform(
        F.filter(_walked(F.col("_o.start"), F.col("_o.cigar")), lambda b: b["len"] > 0),
        lambda b: F.struct(
            b["at"].alias("start"),
            (b["at"] + b["len"]).alias("end"),
            (~aligned(b) | F.col("_o.blank")).alias("gone"),
            F.when(aligned(b), F.slice(F.col("_o.quals"), (b["offset"] + 1).cast("int"), b["len"].cast("int"))).alias("quals"),
        ),
    )
    known = marked.select(*fields, "_mate", other.alias("other"))
    nameless = kept.filter(F.col("name").isNull()).select(*fields)
    blocks = aligned_blocks(known.unionByName(nameless, allowMissingColumns=True), 0, ["_mate", "other"])
    quality = lambda gone, quals, at: F.when(gone, F.lit(-1)).otherwise(F.coalesce(F.get(quals, at.cast("int")), F.lit(0)))

    def letter(i: Column) -> Column:
        own = quality(F.col("seq").isNull(), F.col("quals"), i)
        place = F.col("start") + i

        def beats(b: Column) -> Column:
            theirs = quality(b["gone"], b["quals"], place - b["start"])
            over = F.when(F.col("_mate") == 1, theirs > own).otherwise(theirs >= own)
            return (b["start"] <= place) & (place < b["end"]) & over

        return F.when(F.exists("other", beats), F.lit(LOST)).otherwise(F.coalesce(F.substr("seq", (i + 1).cast("int"), F.lit(1)), F.lit(HIDDEN)))

    touched = F.exists("other", lambda b: (b["start"] < F.col("end")) & (F.col("start") < b["end"]))
    spelt = F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("end") - F.col("start") - 1), letter), "")
    columns = ("chrom", "start", "end", "seq", "quals", "mapq", "is_reverse")
    return blocks.withColumn("seq", F.when(touched, spelt).otherwise(F.col("seq"))).select(*columns)


def _places_sent(points: DataFrame) -> DataFrame | None:
    """Stretches of the axis with the places ``_at`` asked for in them, ``chrom, _bin, _id, _at``; None if they are too many to be sent."""
    width = 1 << PLACE_BITS
    inside = (F.col("_p") - F.col("_bin") * width).cast("int")
    places = points.filter(F.col("chrom").isNotNull() & F.col("_p").isNotNull()).withColumn("_bin", _bin(F.col("_p"), width))
    marks = durable(places.groupBy("chrom", "_bin").agg(F.sort_array(F.collect_set(inside)).alias("_at")))
    size = marks.agg(F.count(F.lit(1)), F.sum(F.size("_at"))).first()
    if size[0] > min(SENT_BINS, (1 << STRETCH_BITS) - 1) or (size[1] or 0) > SENT_PLACES:
        return None
    # At most SENT_BINS rows are numbered; the number stands for chromosome and stretch.
    number = marks.select("chrom", "_bin", F.row_number().over(Window.orderBy("chrom", "_bin")).cast("bigint").alias("_id"))
    return durable(number.join(marks, ["chrom", "_bin"]))


def _letter_code(letter: Column) -> Column:
    return F.when(letter == HIDDEN, F.lit(HIDDEN_LETTER)).when(letter == "", F.lit(BEHIND)).otherwise(F.ascii(F.upper(letter)) + FIRST_LETTER).cast("bigint")


def read_letters(reads: DataFrame, marks: DataFrame, skip_flags: int = SKIP_FLAGS, floor: int = MIN_BASE_QUALITY) -> DataFrame:
    """What kept reads show at the places of ``marks``: a row per read and stretch with ``_letters``, and a first row for every read.

    A letter is one number: quality (-1 for none, 0 if unknown), code and place in the stretch, from the highest bits down; there
    may be fewer than the ``_most`` places between the read's ends. ``marks`` are few and sent to all tasks, so that nothing else of a read has to cross the network.
    """
    width = 1 << PLACE_BITS
    kept = reads.filter(F.col("flag").bitwiseAND(F.lit(skip_flags)) == 0)
    blocks = F.filter(_walked(F.col("start"), F.col("cigar")), lambda b: (b["len"] > 0) & b["at"].isNotNull())
    some, last = F.size("_blocks") > 0, F.element_at("_blocks", -1)
    spans = kept.withColumn("_blocks", blocks).withColumns({"_s": F.when(some, F.col("_blocks")[0]["at"]), "_t": F.when(some, last["at"] + last["len"])})
    cut = spans.select("*", F.posexplode_outer(F.sequence(_bin(F.col("_s"), width), _bin(F.col("_t") - 1, width))).alias("_k", "_bin"))
    first = F.col("_bin") * width
    inside = F.sequence(F.greatest(F.col("_s") - first, F.lit(0)).cast("int"), F.least(F.col("_t") - first, F.lit(width)).cast("int") - 1)
    # The generator keeps the common places from being looked for once for every use of them.
    found = cut.join(F.broadcast(marks), ["chrom", "_bin"], "left").select("*", F.explode(F.array(F.array_intersect(inside, "_at"))).alias("_here"))
    head, most = F.coalesce("_k", F.lit(0)) == 0, F.coalesce(F.size("_here"), F.lit(0))
    found = found.withColumns({"_head": head, "_most": F.greatest(most, F.lit(0))}).filter(F.col("_head") | (F.col("_most") > 0))

    def letter(b: Column, x: Column) -> Column:
        at = (b["offset"] + first + x - b["at"]).cast("int")
        quality, base = F.get("quals", at), F.substr("seq", at + 1, F.lit(1))
        shown = F.when((quality < floor) & ~base.isin(LOST, ""), F.lit(HIDDEN_LETTER).cast("bigint")).otherwise(_letter_code(base))
        number = lambda rank, code: F.shiftleft(rank.cast("bigint"), 32).bitwiseOR(F.shiftleft(code, PLACE_BITS)).bitwiseOR(x.cast("bigint"))
        seen = b["op"].isin(*ALIGNED_OPS) & F.col("seq").isNotNull()
        return F.when(seen, number(F.coalesce(quality, F.lit(0)), shown)).otherwise(number(F.lit(-1), F.lit(NO_LETTER).cast("bigint")))

    over = lambda b, x: (b["at"] <= first + x) & (first + x < b["at"] + b["len"])
    letters = F.flatten(F.transform("_here", lambda x: F.transform(F.filter("_blocks", lambda b: over(b, x)), lambda b: letter(b, x))))
    ends = {"_from": F.col("start") - first, "_e": reference_end(F.col("start"), F.col("cigar")) - first}
    return found.select(
        "chrom", "name", *[c.alias(n) for n, c in ends.items()], "flag", "seq", "mapq", "is_reverse", "_head", "_most", "_id",
        F.when(F.col("_most") > 0, letters).alias("_letters"),
    )


def _shown(seq: Column, quals: Column, floor: int) -> Column:
    """The letters of a piece with those of low quality hidden; where a quality is missing the letter stays."""
    known = F.slice(quals, 1, F.length(seq))
    letter = lambda q, i: F.when((q < floor) & (F.substr(seq, i + 1, F.lit(1)) != LOST), HIDDEN).otherwise(F.substr(seq, i + 1, F.lit(1)))
    mixed = F.concat(F.array_join(F.transform(known, letter), ""), F.substr(seq, F.size(known) + 1))
    return F.when(quals.isNull() | (F.coalesce(F.array_min(quals), F.lit(floor)) >= floor), seq).otherwise(mixed)


def _bits(number: Column, skip: int, count: int) -> Column:
    return F.shiftright(number, skip).bitwiseAND(F.lit((1 << count) - 1))


def _packed(letters: DataFrame) -> DataFrame:
    """Rows of ``read_letters`` as they cross the network: ``name, _w, _near, _far, seq``, numbers with few empty bytes.

    ``name`` is a hash of 64 bits; ``_w`` holds 20 bits of a second one, flag, mapq, strand, the stretch and whether the row is the first of its read.
    ``_near`` is the read's ends and its letters in 32 bits each. Where a value does not fit, ``_far`` has all of them in 64 bits. A
    row without letters is its hashes alone.
    """
    some = F.coalesce(F.size("_letters") > 0, F.lit(False))
    strand = F.when(F.col("is_reverse"), F.lit(2)).when(~F.col("is_reverse"), F.lit(1)).otherwise(F.lit(0))
    length, mapq = F.col("_e") - F.col("_from"), F.coalesce(F.col("mapq").cast("bigint") + 1, F.lit(0))
    code = lambda v: _bits(v, PLACE_BITS, 21)
    fits = (
        F.col("_from").between(-(1 << 15), (1 << 15) - 1) & length.between(0, (1 << 15) - 1) & F.col("flag").between(0, (1 << 12) - 1)
        & F.coalesce(F.col("mapq").between(0, 254), F.lit(True)) & F.forall("_letters", lambda v: F.shiftright(v, 32).between(-1, 254) & (code(v) < 512))
    )
    near = some & F.coalesce(fits, F.lit(False))
    small = lambda v: F.shiftleft(F.shiftright(v, 32) + 1, 20).bitwiseOR(F.shiftleft(code(v), PLACE_BITS)).bitwiseOR(_bits(v, 0, PLACE_BITS))
    ends = F.shiftleft(F.col("_from") + (1 << 15), 15).bitwiseOR(length)
    rest = F.shiftleft(F.col("flag"), 11).bitwiseOR(F.shiftleft(mapq, 2)).bitwiseOR(strand).cast("bigint")
    wide = [F.col(c).cast("bigint") for c in ("_from", "_e", "flag", "mapq")]
    zero = F.lit(0).cast("bigint")
    # The hash lies lowest, beside the other one; above it a row without letters is zeros.
    word = _bits(F.xxhash64("name", "chrom", F.lit(1)), 0, 20)
    for part, skip in ((F.col("_head").cast("bigint"), 20), (F.when(some, F.col("_id")).otherwise(zero), 21), (F.when(near, rest).otherwise(zero), 21 + STRETCH_BITS)):
        word = word.bitwiseOR(F.shiftleft(part, skip))
    return letters.select(
        F.xxhash64("chrom", "name").alias("name"),
        word.alias("_w"),
        F.when(near, F.concat(F.array(ends.cast("int")), F.transform("_letters", lambda v: small(v).cast("int")))).alias("_near"),
        F.when(some & ~near, F.concat(F.array(*wide, strand.cast("bigint")), F.col("_letters"))).alias("_far"),
        F.when(some, F.col("seq")).alias("seq"),
    )


def _unpacked(rows: DataFrame) -> DataFrame:
    """``_packed`` undone: ``name, _h, _head, _id, _from, _e, flag, seq, mapq, is_reverse, _letters``."""
    near, far, rest = F.col("_near"), F.col("_far"), _bits(F.col("_w"), 21 + STRETCH_BITS, 23)
    ends = F.get(near, F.lit(0))
    start, quality = F.shiftright(ends, 15) - (1 << 15), F.when(_bits(rest, 2, 9) > 0, _bits(rest, 2, 9) - 1)
    either = lambda small, k: F.when(near.isNotNull(), small.cast("bigint")).otherwise(F.get(far, F.lit(k)))
    strand = either(_bits(rest, 0, 2), 4)
    large = lambda v: F.shiftleft((F.shiftright(v, 20) - 1).cast("bigint"), 32).bitwiseOR(_bits(v, 0, 20).cast("bigint"))
    behind = lambda values, k: F.slice(values, k + 1, F.size(values) - k)
    return rows.select(
        "name",
        _bits(F.col("_w"), 0, 20).alias("_h"),
        (_bits(F.col("_w"), 20, 1) == 1).alias("_head"),
        _bits(F.col("_w"), 21, STRETCH_BITS).alias("_id"),
        either(start, 0).alias("_from"),
        either(start + _bits(ends, 0, 15), 1).alias("_e"),
        either(_bits(rest, 11, 12), 2).alias("flag"),
        "seq",
        either(quality, 3).alias("mapq"),
        F.when(strand > 0, strand == 2).alias("is_reverse"),
        F.when(near.isNotNull(), F.transform(behind(near, 1), large)).otherwise(behind(far, 5)).alias("_letters"),
    )


def fragment_letters(letters: DataFrame, tasks: int) -> DataFrame:
    """Rows of ``read_letters`` of which every fragment keeps one letter at a place, by the rules of ``fragment_blocks``.

    Both reads of a fragment meet in one shuffle, packed, and under hashes of 84 bits in place of the name.
    """
    named = _unpacked(_packed(letters.filter(F.col("name").isNotNull())).repartition(tasks, "name"))
    beside = Window.partitionBy("name", "_h", "_id").orderBy("_from", "_e", "flag", "seq", "mapq", "is_reverse")
    paired = named.withColumns({"_mate": F.row_number().over(beside), "_o": F.coalesce(F.lag("_letters").over(beside), F.lead("_letters").over(beside))})
    paired = paired.withColumn("_n", F.sum(F.col("_head").cast("int")).over(Window.partitionBy("name", "_h")))
    place = (1 << PLACE_BITS) - 1
    quality = lambda v: F.shiftright(v, 32)

    def beaten(v: Column) -> Column:
        over = lambda o: F.when(F.col("_mate") == 1, quality(o) > quality(v)).otherwise(quality(o) >= quality(v))
        return F.exists("_o", lambda o: (o.bitwiseAND(F.lit(place)) == v.bitwiseAND(F.lit(place))) & over(o))

    kept = F.when((F.col("_n") == 2) & F.col("_o").isNotNull(), F.filter("_letters", lambda v: ~beaten(v))).otherwise(F.col("_letters"))
    met = paired.select("_id", "mapq", "is_reverse", "name", kept.alias("_letters"))
    nameless = letters.filter(F.col("name").isNull())
    return met.unionByName(nameless.select("_id", "mapq", "is_reverse", F.xxhash64("_from", "_letters", "mapq").alias("name"), "_letters"))


def _sums(over: DataFrame, hit: Column) -> DataFrame:
    """Counts per place and alt of pieces ``_n`` times over a place, with their summed mapq ``_q``."""
    none = F.lit(0).cast("bigint")
    place = ["chrom", "_p", "alt"]
    return over.select(*place, hit.alias("hit"), "_n", "_q", "is_reverse").groupBy(*place).agg(
        F.sum("_n").alias("DP"),
        F.sum(F.when(F.col("hit"), F.col("_n")).otherwise(none)).alias("AD"),
        F.sum(F.when(F.col("hit"), F.col("_q")).otherwise(none)).alias("_mq"),
        F.sum(F.when(F.col("hit") & ~F.col("is_reverse"), F.col("_n")).otherwise(none)).alias("_fwd"),
        F.sum(F.when(F.col("hit") & F.col("is_reverse"), F.col("_n")).otherwise(none)).alias("_rev"),
    )


def _evidence(asked: DataFrame, totals: DataFrame) -> DataFrame:
    zero = F.lit(0).cast("bigint")
    filled = asked.join(totals, ["chrom", "_p", "alt"], "left").select(
        "key", *[F.coalesce(F.col(c), zero).alias(c) for c in ("DP", "AD", "_mq", "_fwd", "_rev")]
    )
    support = F.greatest(F.col("AD"), F.lit(1))
    return filled.select(
        "key",
        "DP",
        "AD",
        ratio_or_zero("AD", "DP").alias("VAF"),
        (F.col("_mq").cast("double") / support).alias("MQ"),
        (F.abs(F.col("_fwd") - F.col("_rev")).cast("double") / support).alias("SB"),
    )


def _letter_totals(points: DataFrame, reads: DataFrame, marks: DataFrame, skip_flags: int, floor: int, rows: int) -> DataFrame:
    """Counts per place and alt, each fragment once, from the letters at the places asked for."""
    letters = read_letters(reads, marks, skip_flags, floor)
    counted = durable(letters.groupBy(F.col("_id").alias("_bin")).agg(F.sum("_most").alias("_n"), F.count("name").alias("_named")))
    total, named = counted.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_named"), F.lit(0))).first()
    tasks = _task_count(max(total, named), reads)
    shown = fragment_letters(letters, tasks).select(
        F.col("_id").alias("_bin"), "name", F.col("mapq").cast("bigint").alias("mapq"), "is_reverse", F.explode("_letters").alias("_v")
    )
    width = 1 << PLACE_BITS
    at = lambda part, inside: part * width + inside
    code = F.shiftright("_v", PLACE_BITS).bitwiseAND(F.lit((1 << 21) - 1))
    shown = shown.withColumns({"_k": at(F.col("_bin"), F.col("_v").bitwiseAND(F.lit(width - 1))), "_c": code.cast("int")})
    shown = shown.filter(F.col("_c") != ord(LOST) + FIRST_LETTER)
    numbers = marks.select("chrom", "_bin", "_id")
    placed = points.withColumn("_bin", _bin(F.col("_p"), width)).join(F.broadcast(numbers), ["chrom", "_bin"])
    placed = placed.select("chrom", "_p", "alt", F.col("_id").alias("_bin"), at(F.col("_id"), F.col("_p") - F.col("_bin") * width).alias("_k"))
    busy, keyed = _dealt(shown, placed, F.col("name"), rows, counted, ["_bin"])
    # Letters cross the network without names; equal ones are added up before they meet their place.
    busy = busy.select("_k", "_salt", "_c", "mapq", "is_reverse").repartition(tasks, "_k", "_salt")
    busy = busy.groupBy("_k", "_salt", "_c", "is_reverse").agg(F.count(F.lit(1)).alias("_n"), F.sum("mapq").alias("_q"))
    wanted = F.when(F.length("alt") < 2, _letter_code(F.col("alt")))
    hit = F.coalesce((F.col("_c") > HIDDEN_LETTER) & (F.col("_c") == wanted), F.lit(False))
    return _sums(keyed.drop("_bin").join(busy, ["_k", "_salt"]), hit)


def pileup(
    sites: DataFrame,
    reads: DataFrame,
    skip_flags: int = SKIP_FLAGS,
    min_base_quality: int = MIN_BASE_QUALITY,
    bin_width: int = 128,
    bin_rows: int = BIN_ROWS,
    mates: str = "each",
) -> DataFrame:
    """Read evidence per site: ``key, DP, AD, VAF, MQ, SB``; uncovered sites give zeros.

    ``sites``: key, chrom, pos (1-based), alt. DP counts every read over the site, deletions
    included; AD the reads whose base equals a one-letter alt, so longer alts have AD 0. A row of
    ``sites`` that repeats another one gets the same numbers. ``mates="once"`` counts a fragment once
    where its two reads overlap, see ``fragment_blocks``; reads then need ``name``.

    Places and alts are reduced to different ones first. Reads keep, in each bin, only the letters inside
    the bin that are good enough to be compared, and cross the network once; equal pieces are added up before the join.
    Mates keep only their letters at the places asked for, which are sent to all tasks; where these are too many, mates meet whole.
    """
    if mates not in ("each", "once"):
        raise ValueError("mates must be each or once")
    alt = F.coalesce("alt", F.lit("")).alias("alt")
    asked = sites.select("key", "chrom", (F.col("pos").cast("bigint") - 1).alias("_p"), alt)
    points = asked.select("chrom", "_p", "alt").distinct()
    marks = _places_sent(points) if mates == "once" else None
    if marks is not None:
        return _evidence(asked, _letter_totals(points, reads, marks, skip_flags, min_base_quality, bin_rows))
    blocks = aligned_blocks(reads, skip_flags) if mates == "each" else fragment_blocks(reads, skip_flags)
    points = points.withColumn("_bin", _bin(F.col("_p"), bin_width))
    bins = points.select("chrom", "_bin").distinct()
    few = len(bins.select(F.lit(1)).take(SENT_BINS + 1)) <= SENT_BINS

    def binned(rows: DataFrame) -> DataFrame:
        spans = rows.withColumn("_bin", _bins(F.col("start"), F.col("end"), bin_width))
        return spans.join(F.broadcast(bins), ["chrom", "_bin"], "left_semi") if few else spans

    low = F.greatest("start", F.col("_bin") * bin_width)
    high = F.least("end", (F.col("_bin") + 1) * bin_width)
    skip, size = (low - F.col("start") + 1).cast("int"), (high - low).cast("int")
    cut = binned(blocks).select(
        "chrom",
        "_bin",
        low.alias("start"),
        high.alias("end"),
        F.substr("seq", skip, size).alias("seq"),
        F.slice("quals", skip, size).alias("quals"),
        F.col("mapq").cast("bigint").alias("mapq"),
        "is_reverse",
    )
    pieces = cut.withColumn("seq", _shown(F.col("seq"), F.col("quals"), min_base_quality)).drop("quals")
    # Blocks lie where the reads do, whatever becomes of their letters, so their number needs no letters.
    places = reads.select("chrom", "start", "cigar", "flag", *[F.lit(None).cast(reads.schema[c].dataType).alias(c) for c in ("seq", "quals", "mapq", "is_reverse")])
    counted = durable(binned(aligned_blocks(places, skip_flags)).groupBy("chrom", "_bin").agg(F.count(F.lit(1)).alias("_n")))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    spread = F.xxhash64("start", "end", "seq", "mapq", "is_reverse")
    busy, keyed = _dealt(pieces, points, spread, bin_rows, counted)
    # One shuffle carries the pieces to their sites; equal ones are added up there, before the join.
    same = ["chrom", "_bin", "_salt", "start", "end", "seq", "is_reverse"]
    busy = busy.repartition(_task_count(total, reads), "chrom", "_bin", "_salt")
    busy = busy.groupBy(*same).agg(F.count(F.lit(1)).alias("_n"), F.sum("mapq").alias("_q"))
    over = keyed.join(busy, ["chrom", "_bin", "_salt"]).filter(
        (F.col("start") <= F.col("_p")) & (F.col("_p") < F.col("end"))
    )
    offset = (F.col("_p") - F.col("start") + 1).cast("int")
    base = F.upper(F.substr("seq", offset, F.lit(1)))
    hit = F.coalesce((base != HIDDEN) & (base == F.upper("alt")), F.lit(False))
    over = over.filter(F.coalesce(base != LOST, F.lit(True)))
    return _evidence(asked, _sums(over, hit))


def window_signal(windows: DataFrame, signal: DataFrame, bin_width: int = 256, bin_rows: int = BIN_ROWS) -> DataFrame:
    """Overlap-weighted signal per window: ``key, size, covered, sum, mean``; 0 where nothing overlaps.

    ``windows``: key, chrom, start, end; ``signal``: chrom, start, end, value; both 0-based and
    half-open. A pair is kept in the bin of the later of both starts only, so it counts once. A
    letter under several intervals of the signal counts once for each, in ``covered`` too. A row of
    ``windows`` that repeats another one gets the same numbers.
    """
    kept = windows.filter(F.col("end") > F.col("start")).select("chrom", "start", "end").distinct()
    left = kept.withColumn("_bin", _bins(F.col("start"), F.col("end"), bin_width))
    right = signal.filter(F.col("end") > F.col("start")).select(
        "chrom", F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("value").cast("double").alias("value")
    )
    right = right.withColumn("_bin", _bins(F.col("_s"), F.col("_e"), bin_width))
    # The signal is the long side: what lies in bins without a window goes before anything else.
    right = right.join(left.select("chrom", "_bin").distinct(), ["chrom", "_bin"], "left_semi")
    left, right = _dealt(left, right, F.xxhash64("start", "end"), bin_rows)
    later = F.greatest("start", "_s")
    overlap = F.least("end", "_e") - later
    pairs = left.join(right, ["chrom", "_bin", "_salt"]).filter(
        (overlap > 0) & (_bin(later, bin_width) == F.col("_bin"))
    )
    place = ["chrom", "start", "end"]
    totals = pairs.groupBy(*place).agg(
        F.sum(overlap).alias("covered"), F.sum(F.col("value") * overlap).alias("sum")
    )
    return windows.select("key", *place).join(totals, place, "left").select(
        "key",
        (F.col("end") - F.col("start")).alias("size"),
        F.coalesce("covered", F.lit(0).cast("bigint")).alias("covered"),
        F.coalesce("sum", F.lit(0.0)).alias("sum"),
        ratio_or_zero("sum", "covered").alias("mean"),
    )
