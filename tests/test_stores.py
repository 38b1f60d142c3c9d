"""Blocked gzip, reads by region, ordered batches."""

import gzip
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from callscope.operators import regions
from callscope.sources import batches, blocked, reads, variants

READ = (
    "chrom string, start bigint, cigar array<struct<op:string,len:int>>, seq string, quals array<int>, "
    "mapq int, is_reverse boolean, flag int"
)


def member(data, *others):
    """A gzip member that names its own length, behind other extra fields."""
    pack = zlib.compressobj(6, wbits=-15)
    body = pack.compress(data) + pack.flush()
    extra = b"".join(tag + struct.pack("<H", len(value)) + value for tag, value in others)
    size = 12 + len(extra) + 6 + len(body) + 8
    extra += b"BC" + struct.pack("<HH", 2, size - 1)
    head = b"\x1f\x8b\x08\x04" + b"\0" * 6 + struct.pack("<H", len(extra))
    return head + extra + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def blocked_file(path, text, draw, longest=300, others=()):
    at, out = 0, b""
    while at < len(text):
        size = draw.randint(1, longest)
        out += member(text[at : at + size], *others)
        at += size
    path.write_bytes(out + member(b""))
    return len(out) + 28


def texts():
    draw = random.Random(3)
    lines = ["x" * draw.choice((0, 1, 30, 900)) + f"é{k}" for k in range(400)]
    yield "\n".join(lines)
    yield "\n".join(lines) + "\n"
    yield "\n\n" + "a" * 20_000 + "\nb\n"
    yield "one line"
    yield "\n"


@pytest.mark.parametrize("split", [1, 97, 1000, 1 << 20])
def test_every_line_belongs_to_one_range(tmp_path, split):
    draw = random.Random(split)
    for k, text in enumerate(texts()):
        path = tmp_path / f"{k}.gz"
        size = blocked_file(path, text.encode(), draw, 300 if split > 1 else 5000, [(b"ZZ", b"\x1f\x8b\x08\x04BC")])
        if split == 1 and size > 4000:
            continue
        own = [line for at in range(0, size, split) for line in blocked.lines_of(str(path), at, min(at + split, size))]
        assert [x.decode() for x in own] == text.removesuffix("\n").split("\n")[: None if text != "\n" else 1], k


def test_many_tasks_read_one_file(spark, tmp_path):
    text = "".join(f"line {k} {'z' * (k % 50)}\n" for k in range(20_000))
    size = blocked_file(tmp_path / "many.txt.gz", text.encode(), random.Random(1), 60_000)
    frame = blocked.read_lines(spark, str(tmp_path / "many.txt.gz"), size // 7)
    assert frame.rdd.getNumPartitions() >= 7
    used = frame.select(F.spark_partition_id()).distinct().count()
    assert used >= 5
    assert sorted(r["line"] for r in frame.collect()) == sorted(text.splitlines())


def test_plain_gzip_and_folders(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.gz").write_bytes(gzip.compress(b"a1\na2\n") + gzip.compress(b"a3\n\na5"))
    blocked_file(folder / "b.gz", b"b1\nb2\n", random.Random(2), 2)
    (folder / "_SUCCESS").write_bytes(b"")
    (folder / "empty.gz").write_bytes(b"")
    frame = blocked.read_lines(spark, str(folder), 10)
    assert sorted(r["line"] for r in frame.collect()) == ["", "a1", "a2", "a3", "a5", "b1", "b2"]
    assert {r["file"].rpartition("/")[2] for r in frame.select("file").distinct().collect()} == {"a.gz", "b.gz"}
    with pytest.raises(Exception, match="none"):
        blocked.read_lines(spark, str(tmp_path / "none.gz")).collect()
    (tmp_path / "cut.gz").write_bytes((folder / "b.gz").read_bytes()[:60])
    with pytest.raises(Exception, match="cut off"):
        blocked.read_lines(spark, str(tmp_path / "cut.gz")).collect()


def test_calls_from_blocked_file_equal_those_from_text(spark, tmp_path):
    lines = "##x\n" + "".join(f"chr{k % 5}\t{k if k % 9 else 'p'}\t.\tA\tC,G\t.\tPASS\tAF=0.{k % 7},0.5\n" for k in range(3000))
    (tmp_path / "c.vcf").write_text(lines)
    blocked_file(tmp_path / "c.vcf.gz", lines.encode(), random.Random(3), 4000)
    bag = lambda frame: sorted((tuple(r) for r in frame.collect()), key=str)
    plain, bad = variants.read_vcf(spark, str(tmp_path / "c.vcf"))
    got, bad_too = variants.read_vcf(spark, str(tmp_path / "c.vcf.gz"), blocked=True)
    assert bag(got) == bag(plain) and bag(bad.drop("file")) == bag(bad_too.drop("file"))


def test_one_hot_file_of_many(spark):
    """Column orders differ by file, and one file has nearly all lines."""
    names = list(variants.MAF_COLUMNS)
    rows, want = [], set()
    for k in range(12):
        order = names[k % 5 :] + names[: k % 5]
        rows.append(("\t".join(n.title() for n in order), f"f{k}"))
        for i in range(600 if k == 0 else 3):
            cell = {"chromosome": f"chr{k}", "start_position": str(i), "reference_allele": "A", "tumor_seq_allele2": "C",
                    "ncbi_build": "GRCh38" if i % 3 else "hg19"}
            rows.append(("\t".join(cell[n] for n in order), f"f{k}"))
            if i % 3:
                want.add((str(k), i))
    frame = spark.createDataFrame(rows, "line string, file string").repartition(5)
    got = variants.parse_maf(frame).select("chrom", "pos").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    with pytest.raises(Exception, match="required columns missing in f99"):
        variants.parse_maf(frame.unionByName(spark.createDataFrame([("a\tb", "f99")], "line string, file string"))).collect()


def drawn_reads(n=400):
    draw, rows = random.Random(8), []
    for k in range(n):
        start = draw.choice([draw.randint(0, 3_000_000), (1 << 20) - draw.randint(1, 60), 5_000_000 + draw.randint(0, 50)])
        length = draw.randint(20, 80)
        skip = draw.choice([0, 0, 0, 30_000, 300_000 if k % 8 else 0])
        cigar = [("M", length)] if not skip else [("M", 10), ("N", skip), ("M", length - 10)]
        rows.append((draw.choice(["1", "X"]), start, cigar, "A" * length, None, 60, False, 0))
    return rows


@pytest.mark.parametrize("named", [3, 10_000])
def test_region_access(spark, tmp_path, monkeypatch, named):
    monkeypatch.setattr(reads, "NAMED_BINS", named)
    rows = drawn_reads() + [(None, 5, [("M", 3)], "AAA", None, 1, False, 0), ("1", 7, [("M", 4)], "ACGT", None, 9, True, 0)]
    frame = spark.createDataFrame(rows, READ)
    folder = str(tmp_path / "reads")
    reads.write_reads(frame, folder)
    places = sorted({(r[0], r[1] + 5) for r in rows[:400:9]}) + [("1", (1 << 20) + 1), ("2", 5), ("1", None), ("1", 10)]
    sites = spark.createDataFrame([(str(k), c, p, "A") for k, (c, p) in enumerate(places)], "key string, chrom string, pos bigint, alt string")
    near = reads.read_regions(spark, folder, sites)
    assert set(near.columns) == set(frame.columns)
    bag = lambda f: sorted((tuple(r) for r in f.collect()), key=str)
    assert bag(regions.pileup(sites, near)) == bag(regions.pileup(sites, frame))


def test_bins_hold_reads_whole(spark):
    spans = [(0, 1), (0, 1 << 17), (0, (1 << 17) + 1), ((1 << 20) - 1, (1 << 20) + 1), (5, 700_000_000), (1 << 33, (1 << 33) + 9), (7, 7)]
    frame = spark.createDataFrame(spans, "start bigint, end bigint")
    rows = frame.select("start", "end", reads.bin_of(F.col("start"), F.col("end")).alias("bin"),
                        reads.bins_at(F.col("start")).alias("low"), reads.bins_at(F.col("end") - 1).alias("high")).collect()
    for r in rows:
        if r["end"] > r["start"]:
            assert r["bin"] in r["low"] and r["bin"] in r["high"]
    assert [r["bin"] == reads.UNBOUND for r in rows] == [False] * 4 + [True, False, False]


def test_one_bin_of_many_reads_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(reads, "TASK_READS", 20)
    rows = [("1", k, [("M", 4)], "ACGT", None, 60, False, 0) for k in range(200)]
    reads.write_reads(spark.createDataFrame(rows, READ), str(tmp_path / "reads"))
    assert len(list((tmp_path / "reads").glob("rows/chrom=1/bin=*/*.parquet"))) >= 5


def test_few_bins_are_read_without_a_join(spark, tmp_path):
    rows = [("1", k * 50_000, [("M", 4)], "ACGT", None, 60, False, 0) for k in range(20)]
    folder = str(tmp_path / "reads")
    reads.write_reads(spark.createDataFrame(rows, READ), folder)
    site = spark.createDataFrame([("1", 1)], "chrom string, pos bigint")
    assert "Join" not in reads.read_regions(spark, folder, site)._jdf.queryExecution().executedPlan().toString()


def test_region_access_opens_only_its_bins(spark, tmp_path):
    """All files that a small request does not need are made unreadable."""
    rows = [(c, k * 50_000, [("M", 50)], "A" * 50, None, 60, False, 0) for c in ("1", "2") for k in range(60)]
    folder = tmp_path / "reads"
    reads.write_reads(spark.createDataFrame(rows, READ), str(folder))
    site = spark.createDataFrame([("s", "1", 1_000_010, "A")], "key string, chrom string, pos bigint, alt string")
    needed = {f"bin={(1_000_009 >> bits) + k * reads.KIND}" for k, bits in enumerate(reads.KINDS, 1)}
    broken = 0
    for file in folder.glob("rows/chrom=*/bin=*/*.parquet"):
        if file.parent.parent.name != "chrom=1" or file.parent.name not in needed:
            file.write_bytes(b"broken")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
            broken += 1
    assert broken > 30
    assert [r["DP"] for r in regions.pileup(site, reads.read_regions(spark, str(folder), site)).collect()] == [1]


def test_ranges_of_rows(spark, tmp_path):
    draw = random.Random(4)
    values = [(draw.random(), f"k{k}") for k in range(2503)]
    frame = spark.createDataFrame(values, "x double, key string").repartition(6)
    folder = str(tmp_path / "rows")
    batches.write_ordered(frame, folder, ["x", "key"], 100)
    files = [tuple(r) for r in batches.manifest(spark, folder).orderBy("file").collect()]
    assert files == [(k, 100 * k, 100 if k < 25 else 3) for k in range(26)]
    want = sorted(values)
    for first, stop in ((0, 2503), (0, 1), (99, 101), (777, 1203), (2500, None), (2503, 3000), (5, 5)):
        got = batches.read_range(spark, folder, first, stop).orderBy("row").collect()
        assert [(r["x"], r["key"]) for r in got] == want[first:stop]
    near = batches.read_range(spark, folder, 777, 1203)
    assert len(near.inputFiles()) >= 6
    assert near.select("_metadata.file_path").distinct().count() == 6
    for file in (tmp_path / "rows" / "rows").glob("file=*/*.parquet"):
        if int(file.parent.name[5:]) not in range(7, 13):
            file.write_bytes(b"broken")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    assert batches.read_range(spark, folder, 777, 1203).count() == 426


def test_scoring_goes_on_where_it_stopped(spark, tmp_path):
    frame = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"))
    folder, output = str(tmp_path / "rows"), str(tmp_path / "scores")
    batches.write_ordered(frame, folder, ["x"], 30)
    calls = []

    def score(rows):
        calls.append(1)
        if len(calls) == 4:
            raise RuntimeError("lost")
        return rows.select("row", (F.col("x") * 2).alias("score"))

    with pytest.raises(RuntimeError):
        batches.score_batches(spark, folder, output, score, 5)
    got = batches.score_batches(spark, folder, output, score, 5)
    assert len(calls) == 4 + 4  # three batches were done, the fourth of seven is done again
    assert sorted(tuple(r) for r in got.collect()) == [(k, 2 * k) for k in range(1000)]


def test_empty_store(spark, tmp_path):
    folder = str(tmp_path / "rows")
    batches.write_ordered(spark.range(0), folder, ["id"])
    assert batches.read_range(spark, folder).collect() == [] and batches.manifest(spark, folder).count() == 0
    assert batches.score_batches(spark, folder, str(tmp_path / "out"), lambda rows: rows).collect() == []
