import random

import pytest
from pyspark.sql import functions as F

from callscope.operators import features, regions
from callscope.sources import fasta
from callscope.sources.schemas import READS


def test_windows(spark):
    frame = spark.createDataFrame([("chr1", 50, "A", "C"), ("2", 500, "A", "C")], "chrom string, pos bigint, ref string, alt string")
    assert [tuple(r) for r in regions.site_windows(frame, 100).collect()] == [
        ("1", 0, 150, "1:50:A:C"),
        ("2", 399, 600, "2:500:A:C"),
    ]
    with pytest.raises(ValueError):
        regions.site_windows(frame, 0)


def walk(read):
    """Reference position -> (base or None, quality) of one read."""
    at, offset, over = read[1], 0, {}
    for op, length in read[3]:
        for _ in range(length):
            if op in "M=X":
                over[at] = (read[4][offset], read[5][offset] if read[5] else None)
            elif op in "DN":
                over[at] = (None, None)
            at += op in "M=XDN"
            offset += op in "M=XIS"
    return over


def expected_pileup(site, reads, floor=13):
    dp = ad = mq = forward = reverse = 0
    for read in reads:
        if read[0] != site[1] or read[8] & regions.SKIP_FLAGS:
            continue
        over = walk(read)
        if site[2] - 1 not in over:
            continue
        dp += 1
        base, quality = over[site[2] - 1]
        if base is not None and base.upper() == site[3].upper() and (quality is None or quality >= floor):
            ad += 1
            mq += read[6]
            reverse += read[7]
            forward += not read[7]
    return site[0], dp, ad, ad / dp if dp else 0.0, mq / max(ad, 1), abs(forward - reverse) / max(ad, 1)


@pytest.mark.parametrize("bin_width,bin_rows", [(16, 5), (128, 50_000)])
def test_pileup(spark, bin_width, bin_rows):
    source = random.Random(1)
    shapes = [
        [("M", 20)], [("S", 3), ("M", 10), ("I", 2), ("M", 8)], [("M", 7), ("D", 4), ("M", 9)],
        [("M", 5), ("N", 30), ("M", 6), ("S", 2)], [("=", 4), ("X", 1), ("=", 6)], [("H", 5), ("M", 12)],
    ]
    reads = []
    for i in range(300):
        cigar = source.choice(shapes)
        size = sum(n for op, n in cigar if op in "M=XIS")
        start = source.randrange(0, 90)
        end = start + sum(n for op, n in cigar if op in "M=XDN")
        quals = None if i % 5 == 0 else [source.randrange(5, 40) for _ in range(size)]
        reads.append(
            (source.choice(["1", "2"]), start, end, cigar, "".join(source.choice("ACGTacgt") for _ in range(size)), quals,
             source.randrange(0, 60), source.random() < 0.5, source.choice([0, 0, 0, 16, 4, 1024]))
        )
    # A third of all reads over one place.
    reads += [("1", 40, 50, [("M", 10)], "A" * 10, None, 60, False, 0)] * 150
    sites = [(f"s{c}{p}{a}", c, p, a) for c in "12" for p in (1, 5, 30, 41, 45, 80, 300) for a in ("A", "g", "AC")]
    sites += sites[:9]  # repeated keys get the same numbers, not their sum
    got = regions.pileup(
        spark.createDataFrame(sites, "key string, chrom string, pos bigint, alt string"),
        spark.createDataFrame(reads, READS),
        bin_width=bin_width,
        bin_rows=bin_rows,
    )
    assert sorted(map(tuple, got.collect())) == sorted(expected_pileup(s, reads) for s in sites)


def once(reads):
    """Reads of each fragment with the places that a fragment's other read holds taken out."""
    kept = [r for r in reads if not r[8] & regions.SKIP_FLAGS]
    overs = [walk(r) for r in kept]
    ends = [r[1] + sum(n for op, n in r[3] if op in "M=XDN") for r in kept]
    for i, read in enumerate(kept):
        same = [j for j, other in enumerate(kept) if read[9] is not None and (other[0], other[9]) == (read[0], read[9])]
        if len(same) != 2 or i != same[0]:
            continue
        a, b = sorted(same, key=lambda j: (kept[j][1], ends[j], kept[j][8], kept[j][4], kept[j][6], kept[j][7]))
        for place in set(overs[a]) & set(overs[b]):
            quality = [-1 if base is None else (q or 0) for base, q in (overs[a][place], overs[b][place])]
            del overs[b if quality[0] >= quality[1] else a][place]
    return list(zip(kept, overs))


@pytest.mark.parametrize("skip", [0, 1])
def test_mates_count_once(spark, skip):
    source, reads = random.Random(20 + skip), []
    shapes = [[("M", 20)], [("S", 3), ("M", 10), ("I", 2), ("M", 8)], [("M", 7), ("D", 4), ("M", 9)], [("M", 5), ("N", 30), ("M", 6)]]
    for i in range(160):
        for _ in range(source.choice([1, 2, 2, 2, 3])):
            cigar = source.choice(shapes)
            size, start = sum(n for op, n in cigar if op in "M=XIS"), source.randrange(0, 60)
            quals = None if i % 7 == 0 else [source.randrange(8, 20) for _ in range(size)]
            reads.append((source.choice("11112"), start, start + sum(n for op, n in cigar if op in "M=XDN"), cigar,
                          "".join(source.choice("ACGT") for _ in range(size)), quals, source.randrange(60), source.random() < 0.5,
                          source.choice([0, 64, 128, 1024]), None if i % 11 == 0 else f"f{i}"))
    sites = [(f"s{c}{p}{a}", c, p, a) for c in "12" for p in range(1, 95, 3) for a in "AG"]
    frame = spark.createDataFrame(reads, READS + ", name string")
    got = regions.pileup(spark.createDataFrame(sites, "key string, chrom string, pos bigint, alt string"), frame, mates="once", bin_width=16)
    want = []
    for key, chrom, pos, alt in sites:
        over = [(r, o[pos - 1]) for r, o in once(reads) if r[0] == chrom and pos - 1 in o]
        hits = [r for r, (base, q) in over if base == alt and (q is None or q >= 13)]
        forward = sum(not r[7] for r in hits)
        want.append((key, len(over), len(hits), len(hits) / len(over) if over else 0.0, sum(r[6] for r in hits) / max(len(hits), 1),
                     abs(2 * forward - len(hits)) / max(len(hits), 1)))
    assert sorted(map(tuple, got.collect())) == sorted(want)
    with pytest.raises(ValueError, match="mates"):
        regions.pileup(frame, frame, mates="twice")


@pytest.mark.parametrize("bin_width", [8, 256])
def test_window_signal(spark, bin_width):
    source = random.Random(2)
    windows = [(f"w{i}", "1", s, s + source.randrange(0, 60)) for i, s in enumerate(source.choices(range(200), k=40))]
    windows += windows[:5]
    signal = [("1", s, s + source.randrange(0, 30), float(source.randrange(9))) for s in source.choices(range(220), k=60)]
    got = regions.window_signal(
        spark.createDataFrame(windows, "key string, chrom string, start bigint, end bigint"),
        spark.createDataFrame(signal, "chrom string, start bigint, end bigint, value double"),
        bin_width,
        bin_rows=3,
    )
    assert got.count() == len(windows)
    for key, size, covered, total, mean in got.collect():
        _, _, s, e = next(w for w in windows if w[0] == key)
        parts = [(max(0, min(e, b) - max(s, a)), v) for _, a, b, v in signal]
        want = sum(o for o, _ in parts), sum(o * v for o, v in parts)
        assert (size, covered, total) == (e - s, *want)
        assert mean == pytest.approx(want[1] / want[0] if want[0] else 0)


def test_range_joins_are_not_cartesian(spark):
    sites = spark.createDataFrame([("a", "1", 5, "A")], "key string, chrom string, pos bigint, alt string")
    reads = spark.createDataFrame([], READS)
    plan = regions.pileup(sites, reads)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "Python" not in plan


def test_sequence_windows(spark):
    text = "".join(random.Random(3).choice("ACGTN") for _ in range(95))
    contigs = spark.createDataFrame([("c", text), ("short", "ACG")], "contig string, text string")
    chunks = fasta.chunk_text(contigs, stride=10, halo=14)
    sites = spark.createDataFrame(
        [(i, "c", p) for i, p in enumerate((1, 3, 10, 11, 50, 90, 95, 99, 200))] + [(90, "short", 2), (91, "none", 5)],
        "id int, contig string, pos bigint",
    )
    for row in features.sequence_windows(sites, chunks, radius=7, stride=10).collect():
        source = {"c": text, "short": "ACG"}.get(row["contig"])
        start = row["pos"] - 1 - 7
        if source is None or start >= len(source):
            assert row["seq"] is None
        else:
            assert row["seq"] == "".join(source[i] if 0 <= i < len(source) else "N" for i in range(start, start + 15))


def test_merge_and_features(spark):
    first = spark.createDataFrame([("a", 1.0), ("b", None)], "key string, mean double")
    second = spark.createDataFrame([("b", 2.0), ("c", 3.0)], "key string, mean double")
    evidence = spark.createDataFrame([("c", "5", "x", 0.1, 1.0, 0.0), ("d", "7", "2", 0.2, 2.0, 1.0)],
                                     "key string, DP string, AD string, VAF double, MQ double, SB double")
    merged = features.merge_evidence(first, second, evidence)
    got = {r["key"]: tuple(r)[1:] for r in merged.collect()}
    assert got == {
        "a": (0, 0, 0, 0, 0, 1, 0), "b": (0, 0, 0, 0, 0, 0, 2), "c": (5, 0, 0.1, 1, 0, 0, 3), "d": (7, 2, 0.2, 2, 1, 0, 0),
    }
    alone = features.merge_evidence(first, second)
    assert alone.count() == 3 and alone.agg(F.sum("DP")).first()[0] == 0
    variants = spark.createDataFrame([("c", "c", 5, 1), ("z", "c", 6, 0)], "key string, contig string, pos bigint, label int")
    chunks = fasta.chunk_text(spark.createDataFrame([("c", "ACGTACGTAC")], "contig string, text string"), 10, 14)
    rows = {r["key"]: r for r in features.feature_rows(variants, merged, chunks, radius=2, stride=10).collect()}
    assert [round(v, 3) for v in rows["c"]["qc"]] == [5, 0, 0.1, 1, 0, 0, 3] and rows["z"]["qc"] == [0.0] * 7
    assert len(rows["c"]["seq"]) == 4 and [list(r) for r in rows["c"]["seq"]][0] == [0, 0, 1, 0, 0]


def test_short_halo_is_an_error(spark):
    contigs = spark.createDataFrame([("c", "ACGT" * 3000)], "contig string, text string")
    sites = spark.createDataFrame([("c", 4391)], "contig string, pos bigint")
    with pytest.raises(Exception, match="halo"):
        features.sequence_windows(sites, fasta.chunk_text(contigs, halo=512), radius=300).collect()
    row = features.sequence_windows(sites, fasta.chunk_text(contigs, halo=600), radius=300).first()
    assert row["seq"] == ("ACGT" * 3000)[4391 - 1 - 300 : 4391 + 300]


def test_identical_reads_merge(spark):
    reads = spark.range(100_000).selectExpr(
        "'1' AS chrom", "40L AS start", "array(named_struct('op', 'M', 'len', 10)) AS cigar", "'AAAAAAAAAA' AS seq",
        "CAST(NULL AS array<int>) AS quals", "60 AS mapq", "false AS is_reverse", "0 AS flag",
    )
    sites = spark.createDataFrame([("a", "1", 45, "A")], "key string, chrom string, pos bigint, alt string")
    row = regions.pileup(sites, reads).first()
    assert (row["DP"], row["AD"], row["MQ"]) == (100_000, 100_000, 60.0)


@pytest.mark.parametrize("mates", ["each", "once"])
def test_pieces_cross_the_network_once(spark, mates):
    """No shuffle by letters or qualities, and one in which mates meet."""
    import re

    reads = spark.createDataFrame(
        [(f"f{k // 2}", "1", 10 + k % 2, [("M", 4)], "ACGT", [20, 5, 20, 5], 50, False, 0) for k in range(8)],
        "name string, chrom string, start bigint, cigar array<struct<op:string,len:int>>, seq string, quals array<int>, "
        "mapq int, is_reverse boolean, flag int",
    )
    sites = spark.createDataFrame([("a", "1", 11, "A"), ("b", "1", 12, "C")], "key string, chrom string, pos bigint, alt string")
    found = regions.pileup(sites, reads, mates=mates)
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert not any("seq#" in x or "quals#" in x for x in keys)
    assert sum("name#" in x for x in keys) == (mates == "once")
    assert plan.count("_full#") and not re.search(r"SortMergeJoin \[chrom#\d+, _bin#\d+L\], \[[^\]]*\], LeftOuter", plan)
    assert {r["key"]: (r["DP"], r["AD"]) for r in found.collect()} == {"a": (4, 4), "b": (8, 0) if mates == "each" else (4, 0)}


def test_tasks_follow_from_counted_reads(spark, monkeypatch):
    """Both shuffles of a pileup of mates are cut by rows, not by a setting."""
    monkeypatch.setattr(regions, "TASK_PIECES", 10)
    reads = spark.createDataFrame(
        [(f"f{k // 2}", "1", 10 + k % 2, [("M", 4)], "ACGT", None, 50, False, 0) for k in range(200)],
        "name string, chrom string, start bigint, cigar array<struct<op:string,len:int>>, seq string, quals array<int>, "
        "mapq int, is_reverse boolean, flag int",
    )
    sites = spark.createDataFrame([("a", "1", 11, "A")], "key string, chrom string, pos bigint, alt string")
    found = regions.pileup(sites, reads, mates="once")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count(", 20), REPARTITION_BY_NUM") == 2
    assert found.first()["DP"] == 100


NAMED = READS + ", name string"
ASKED = "key string, chrom string, pos bigint, alt string"


def evidence_once(site, shown, floor=13):
    key, chrom, pos, alt = site
    over = [(r, o[pos - 1]) for r, o in shown if r[0] == chrom and pos - 1 in o]
    hits = [r for r, (base, q) in over if base is not None and base.upper() == alt.upper() and (q is None or q >= floor)]
    forward = sum(not r[7] for r in hits)
    return (key, len(over), len(hits), len(hits) / len(over) if over else 0.0, sum(r[6] for r in hits) / max(len(hits), 1),
            abs(2 * forward - len(hits)) / max(len(hits), 1))


def test_mates_cross_the_network_without_their_reads(spark):
    """Where mates meet there are no qualities, CIGARs and names, and a read without an asked place is its hashes alone."""
    import re

    reads = spark.createDataFrame([("1", s, s + 4, [("M", 4)], "ACGT", [20] * 4, 50, False, f, "a") for s, f in ((10, 64), (900, 128))], NAMED)
    sites = spark.createDataFrame([("a", "1", 12, "C")], ASKED)
    found = regions.pileup(sites, reads, mates="once")
    assert found.first()["AD"] == 1
    plan = spark._jvm.PythonSQLUtils.explainString(found._jdf.queryExecution(), "formatted")
    meet = [x for x in re.findall(r"Exchange *\nInput \[\d+\]: \[([^]]*)\]\nArguments: hashpartitioning\(name#", plan)]
    assert meet and not any(c + "#" in x for x in meet for c in ("quals", "cigar", "chrom", "start"))
    marks = regions._places_sent(sites.select("chrom", (F.col("pos") - 1).alias("_p"), "alt"))
    rows = regions._packed(regions.read_letters(reads, marks)).select("_near", "_far", "seq").collect()
    assert sorted(x["seq"] is None and x["_near"] is None for x in rows) == [False, True] and all(x["_far"] is None for x in rows)


@pytest.mark.parametrize("sent", [regions.SENT_PLACES, 0])
def test_odd_mates_count_once(spark, monkeypatch, sent):
    """Values that do not fit small numbers, letters that are not ACGT, ends of stretches, equal places and flags, both ways of meeting."""
    monkeypatch.setattr(regions, "SENT_PLACES", sent)
    source, reads = random.Random(41), []
    shapes = [[("M", 20)], [("S", 3), ("M", 10), ("I", 2), ("M", 8)], [("M", 7), ("D", 4), ("M", 9)], [("M", 5), ("N", 4100), ("M", 6)]]
    for i in range(150):
        starts = [source.choice([0, 1, 2, 3, 2040, 2041, 4090, 70_000])] * 2
        cigar = source.choice(shapes)
        for start in starts + [starts[0] + 1] * (i % 13 == 0):
            cigar = cigar if i % 3 else source.choice(shapes)
            size, span = sum(n for op, n in cigar if op in "M=XIS"), sum(n for op, n in cigar if op in "M=XDN")
            quals = None if i % 7 == 0 else [source.choice([5, 12, 13, 13, 30, 300]) for _ in range(size)]
            reads.append((source.choice("1112"), start, start + span, cigar, "".join(source.choice("ACGTacN\u0394") for _ in range(size)), quals,
                          source.choice([0, 60, 60, 255, 1000]), source.random() < 0.5, source.choice([0, 64, 64, 128, 1 << 14]), f"f{i}" if i % 11 else None))
    # Longer than the small numbers hold, and a read that begins far ahead of its last stretch.
    for name, flag in (("long", 64), ("long", 128)):
        reads.append(("1", 0, 40_000, [("M", 5), ("N", 39_990), ("M", 5)], "ACGTAACGTA", [20 + flag // 64] * 10, 60, flag == 128, flag, name))
    places = [*range(1, 30), *range(2040, 2070), *range(4090, 4125), 6150, 39_998, 70_003, 70_010]
    sites = [(f"s{c}{p}{a}", c, p, a) for c in "12" for p in places for a in "A\u0394"] + [("gap", "1", 10, "-"), ("two", "1", 2, "AC"), ("none", None, 2, "A")]
    got = regions.pileup(spark.createDataFrame(sites, ASKED), spark.createDataFrame(reads, NAMED), mates="once", bin_rows=20)
    shown = once(reads)
    assert sorted(map(tuple, got.collect())) == sorted(evidence_once(s, shown) for s in sites)


def test_missing_values_of_mates(spark):
    """Nulls of reads: unknown ends, mapq and strand, no letters, no qualities; a read that cannot be placed still counts to its name."""
    m = [("M", 4)]
    rows = [
        ("1", 10, None, m, "ACGT", None, None, None, 64, "a"), ("1", 11, None, m, "CGTA", [20] * 4, 30, True, 128, "a"),
        ("1", 10, None, m, None, [20] * 4, 30, False, 64, "b"), ("1", 10, None, m, "ACGT", [20, 20], 30, False, 128, "b"),
        ("1", 10, None, m, "ACGT", None, 7, False, 64, "c"), ("1", 10, None, m, "ACGT", None, 9, False, 128, "c"),
        ("1", None, None, m, "ACGT", None, 9, False, 128, "c"), ("1", 10, None, [("M", 2), ("M", None)], "ACGT", None, 5, False, 64, "d"),
        ("1", 10, None, m, "ACGT", None, 5, False, None, "e"), (None, 10, None, m, "ACGT", None, 5, False, 0, "f"),
    ]
    sites = [("x", "1", 12, "C"), ("y", "1", 13, "G")]
    got = {r["key"]: tuple(r)[1:3] + (r["MQ"], r["SB"]) for r in regions.pileup(spark.createDataFrame(sites, ASKED), spark.createDataFrame(rows, NAMED), mates="once").collect()}
    assert got == {"x": (5, 5, (30 + 30 + 7 + 9 + 5) / 5, 3 / 5), "y": (4, 4, (30 + 30 + 7 + 9) / 4, 2 / 4)}


def test_hidden_letters(spark):
    """Low qualities hide letters but not what the mate took; without a quality a letter stays."""
    rows = [("ACGT", [20, 5, None, 12]), ("A.GT", [5, 5, 5, 5]), ("ACGT", None), (None, [1, 2]), ("ACGT", [5]), ("", [5])]
    frame = spark.createDataFrame(rows, "seq string, quals array<int>")
    got = [r[0] for r in frame.select(regions._shown(F.col("seq"), F.col("quals"), 13)).collect()]
    assert got == ["A\x01G\x01", "\x01.\x01\x01", "ACGT", None, "\x01CGT", ""]


def test_hot_and_sparse_bins_without_sent_bins(spark, monkeypatch):
    monkeypatch.setattr(regions, "SENT_BINS", 0)
    reads = spark.createDataFrame(
        [("1", k % 5, [("M", 4)], "ACGT", None, 50, k % 2 == 0, 0) for k in range(100)] + [("2", 900, [("M", 4)], "ACGT", None, 50, False, 0)],
        "chrom string, start bigint, cigar array<struct<op:string,len:int>>, seq string, quals array<int>, mapq int, is_reverse boolean, flag int",
    )
    sites = spark.createDataFrame([("a", "1", 3, "A"), ("b", "3", 3, "A")], "key string, chrom string, pos bigint, alt string")
    got = {r["key"]: (r["DP"], r["AD"]) for r in regions.pileup(sites, reads, bin_width=4, bin_rows=7).collect()}
    assert got == {"a": (60, 20), "b": (0, 0)}
