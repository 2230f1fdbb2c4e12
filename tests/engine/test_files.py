"""Readers and writers of files."""

import gzip
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from loomgrid import cli
from loomgrid.functions import flags
from loomgrid.sources import alignments, text, vcf

SAM = """@HD\tVN:1.6
@SQ\tSN:chr1\tLN:60
@RG\tID:x\tSM:sam1
r1\t0\tchr1\t1\t60\t4M1I3M\t*\t0\t0\tACGTTACG\tIIIIIIII\tNM:i:1\tRG:Z:x
r2\t16\tchr1\t5\t20\t5H0I4M\t=\t9\t-10\tACGT\t*
r3\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*
"""


def bam_of(path):
    """A small binary file: one reference, two reads."""
    def record(name, flag, pos, cigar, seq, qual, tags=b""):
        letters = "=ACMGRSVTWYHKDBN"
        ops = b"".join(struct.pack("<I", n << 4 | "MIDNSHP=X".index(o)) for n, o in cigar)
        codes = [letters.index(c) for c in seq] + [0]
        packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(cigar), flag, len(seq), -1, -1, 0) + name.encode() + b"\0" + ops + packed + qual + tags
        return struct.pack("<i", len(body)) + body

    head = b"@SQ\tSN:chr1\tLN:60\n@RG\tID:x\tSM:bam1\n"
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 60)
    data += record("a", 0, 4, [(3, "M"), (1, "D"), (2, "M")], "ACGTN", bytes([30] * 5), b"NMC\x02XZZhi\0")
    data += record("b", 16, 9, [(2, "S"), (2, "M")], "RCGT", bytes([255] * 4))
    with open(path, "wb") as f:
        for part in (data[:50], data[50:]):
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            f.write(c.compress(part) + c.flush())


def test_alignments(spark, tmp_path):
    (tmp_path / "x.first.sam").write_text(SAM)
    bam_of(tmp_path / "y.bam")
    alignments.register(spark)
    rows = {r.qname: r for r in spark.read.format("alignments").load(str(tmp_path)+"/*am").collect()}
    assert rows["r1"].sample_id == "sam1" and rows["r1"].tags == {"NM": "1", "RG": "x"} and rows["r1"].pos0 == 0
    assert rows["r2"].mate_chrom == "chr1" and rows["r3"].chrom is None and rows["r3"].pos0 == -1
    a, b = rows["a"], rows["b"]
    assert (a.sample_id, a.chrom, a.pos0, a.cigar, a.seq, a.qual) == ("bam1", "chr1", 4, "3M1D2M", "ACGTN", "?????") and a.tags == {"NM": "2", "XZ": "hi"}
    assert (b.flag, b.cigar, b.seq, b.qual) == (16, "2S2M", " CGT", "*")
    named = spark.read.format("alignments").option("samplefromname", "true").load(str(tmp_path / "x.first.sam"))
    assert named.first().sample_id == "x"
    assert alignments.region(named, "chr1", 8, 9).where("qname = 'r2'").count() == 1
    assert named.where(flags.caller_reads(F.col("flag"), F.col("mapq"))).count() == 2
    with pytest.raises(Exception, match="CRAM"):
        spark.read.format("alignments").load(str(tmp_path / "z.cram")).collect()


def test_text_files(spark, tmp_path):
    (tmp_path / "l").write_text("a.bam extra\n\nb.bam")
    assert [r.path for r in text.read_list(spark, str(tmp_path / "l")).collect()] == ["a.bam", "b.bam"]
    (tmp_path / "g").write_text("s1\tg1\ns2 g2")
    assert {tuple(r) for r in text.read_groups(spark, str(tmp_path / "g")).collect()} == {("s1", "g1"), ("s2", "g2")}
    (tmp_path / "b.bed").write_text("#c\ntrack x\nchrY\t100\t200\r\nchrY\t150\nchrY\t9\t9\nchrY\tx\t5\nchr1\t1000\t2000\tn\n")
    assert {tuple(r) for r in text.read_bed(spark, str(tmp_path / "b.bed")).collect()} == {("chrY", 101, 200), ("chr1", 1001, 2000)}
    (tmp_path / "f.fai").write_text("c1\t1000\t5\nc2\t500\t9\n")
    assert {tuple(r) for r in text.read_fai(spark, str(tmp_path / "f.fai"), ["c2"]).collect()} == {("c2", 500)}
    (tmp_path / "bad.fai").write_text("c1\tx\n")
    with pytest.raises(Exception, match="malformed"):
        text.read_fai(spark, str(tmp_path / "bad.fai")).collect()


def test_fasta(spark, tmp_path):
    with gzip.open(tmp_path / "r.fa.gz", "wt") as f:
        f.write(">c1 note\nACGT\nACGTAC\n>c2\nGG\n")
    chunks = text.read_fasta(spark, str(tmp_path / "r.fa.gz"), chunk=4, overlap=2)
    assert {(r.chrom, r.chunk): r.seq for r in chunks.collect()} == {("c1", 0): "ACGTAC", ("c1", 1): "ACGTAC", ("c1", 2): "AC", ("c2", 0): "GG"}
    assert {tuple(r) for r in text.catalog(chunks, 4).collect()} == {("c1", 10), ("c2", 2)}


VCF = "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr1\t5\t.\tA\tC,G\t50\tPASS\tDP=9;AF=0.1,0.2\tGT:DP\t0/2:4\t./.\nchr1\t9\t.\tT\t.\t.\t.\tDP=1\tGT\t0|0\t0/0\n"


def test_vcf_round_trip(spark, tmp_path):
    (tmp_path / "x.vcf").write_text(VCF)
    sites, names = vcf.read_vcf(spark, str(tmp_path / "x.vcf"))
    assert names == ["s1", "s2"]
    first = sites.orderBy("pos").first()
    assert first.alts == ["C", "G"] and first.info["DP"] == "9" and first.qual == 50.0
    calls = {(r.pos, r.sample_id): r for r in vcf.calls_of(sites, names).collect()}
    assert calls[5, "s1"].gt == [0, 2] and calls[5, "s2"].gt == [-1, -1] and calls[5, "s1"].fields["DP"] == "4" and calls[9, "s1"].gt == [0, 0]
    body = spark.createDataFrame([("chr2", 3, "A", ["C"], 10, "DP=2"), ("chr1", 7, "A", ["A"], 10, "DP=2"), ("chr1", 8, "A", ["C"], 0, "DP=2")], "chrom string, pos long, ref string, alts array<string>, qual int, info string")
    texts = spark.createDataFrame([("chr2", 3, "s2", "0/1:9:1,0,9:1,1:2")], "chrom string, pos long, sample_id string, text string")
    out = [r.value for r in vcf.lines(body, texts, ["s1", "s2"], {"chr1": 0, "chr2": 1}).collect()]
    assert out == ["chr1\t8\t.\tA\tC\t.\t.\tDP=2\tGT:GQ:PL:AD:DP\t./.\t./.", "chr2\t3\t.\tA\tC\t10\t.\tDP=2\tGT:GQ:PL:AD:DP\t./.\t0/1:9:1,0,9:1,1:2"]
    vcf.write(vcf.lines(body, texts, ["s1"]), vcf.header(["s1"], [("chr1", 60)], ["EU"]), str(tmp_path / "o.vcf"))
    assert spark.read.text(str(tmp_path / "o.vcf/header")).count() == len(vcf.header(["s1"], [("chr1", 60)], ["EU"]))
    with pytest.raises(ValueError):
        vcf.write(body, [], "x.bcf")


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "f.fai").write_text("c1\t1000\nc2\t500\n")
    cli.run(["pipeline", "-o", "out", "--ref_fai", str(tmp_path / "f.fai"), "-d", "600", "-Q", "20"])
    assert capsys.readouterr().out.splitlines()[0] == "loomgrid caller -Q 20 -r c1:1-600 -o out/c1.1-600.vcf.gz"
    (tmp_path / "x.sam").write_text(SAM)
    (tmp_path / "r.fa").write_text(">chr1\n" + "ACGTACGTAC" * 6 + "\n")
    cli.run(["caller", "-f", str(tmp_path / "r.fa"), "-I", str(tmp_path / "x.sam"), "-o", str(tmp_path / "sites")])
    cli.run(["dump", str(tmp_path / "sites"), "-n", "5"])
    cli.run(["motif", "-I", str(tmp_path / "x.sam"), "-o", str(tmp_path / "m"), "-l", "2"])
    assert spark.read.csv(str(tmp_path / "m"), sep="\t", header=True).count() == 16
    cli.run(["fetalfrac", "-I", str(tmp_path / "x.sam"), "-o", str(tmp_path / "ff"), "--calibrate"])
    (tmp_path / "x.vcf").write_text(VCF)
    cli.run(["subsam", "-i", str(tmp_path / "x.vcf"), "-o", str(tmp_path / "sub"), "s1"])
    assert [r.alts for r in spark.read.parquet(str(tmp_path / "sub")).orderBy("pos").collect()][0] == ["G"]
    cli.run(["concat", "-o", str(tmp_path / "all"), "-n", str(tmp_path / "x.vcf"), str(tmp_path / "x.vcf")])
    assert spark.read.parquet(str(tmp_path / "all")).count() == 4
    with pytest.raises(SystemExit):
        cli.run(["subsam", "-i", str(tmp_path / "x.vcf"), "-o", str(tmp_path / "sub"), "nobody"])


def test_regions_are_united(spark, tmp_path):
    rows = [("chr1", p, "A", "C" if i % 2 else "A", 30, 60, f"S{i}", "+", 1, False) for p in (5, 50, 500) for i in range(20)]
    spark.createDataFrame(rows, "chrom string, pos long, ref_base string, read_base string, bq int, mapq int, sample_id string, strand string, rpr long, is_dup boolean").write.parquet(str(tmp_path / "p"))
    for regions, want in (("chr1:1-9", [5]), ("chr1:1-9,chr1:40-60", [5, 50]), ("chr1:40-60,chr1:45-55,chr1:400", [50, 500]), ("", [5, 50, 500]), ("chr2", [])):
        cli.run(["caller", "-I", str(tmp_path / "p"), "-o", str(tmp_path / "out"), "-r", regions])
        assert sorted(r.pos for r in spark.read.parquet(str(tmp_path / "out")).collect()) == want


def test_a_primary_read_isnt_lost_to_another_of_its_name(spark, tmp_path):
    lines = "".join(f"r1\t{flag}\tchr1\t{pos}\t60\t8M\t*\t0\t0\t{seq}\tIIIIIIII\n" for flag, pos, seq in ((2048, 30, "GGGGGGGG"), (0, 1, "ACGTACGT"), (256, 40, "TTTTTTTT")))
    (tmp_path / "x.sam").write_text("@SQ\tSN:chr1\tLN:60\n@RG\tID:x\tSM:s\n" + lines)
    for regions in ("", "chr1:1-20,chr1:1-9"):
        cli.run(["motif", "-I", str(tmp_path / "x.sam"), "-o", str(tmp_path / "m"), "-l", "2", "-r", regions])
        assert {r.motif: int(r["count"]) for r in spark.read.csv(str(tmp_path / "m"), sep="\t", header=True).collect() if r["count"] != "0"} == {"AC": 1}


def test_streaming(spark, tmp_path):
    from loomgrid.streaming import ingest

    rows = spark.createDataFrame([(1, "chrY", 5000000), (1, "chr1", 5), (2, "chrY", 20000)], "sample_id long, chrom string, pos long")
    rows.write.parquet(str(tmp_path / "in"))
    live = ingest.sex_counters(ingest.arriving(spark, str(tmp_path / "in"), rows.schema), F.lit(True))
    q = live.writeStream.outputMode("complete").format("memory").queryName("sex").start()
    q.processAllAvailable()
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.sql("select * from sex").collect()} == {(1, 2, 2, 4), (2, 0, 0, 2)}
