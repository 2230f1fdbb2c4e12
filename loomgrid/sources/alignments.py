"""Alignment files, text and binary, as a Python data source."""

from __future__ import annotations

import glob
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "file string, sample_id string, qname string, flag int, chrom string, pos0 long, mapq int, cigar string, mate_chrom string, mate_pos0 long, isize long, seq string, qual string, tags map<string,string>"
#: Letters of the binary form's codes; codes for mixed bases are read as blanks.
OPS, LETTERS = "MIDNSHP=X", " AC G   T      N"


def header_sample(lines: list[str]) -> str | None:
    """``SM`` of the first read group that has one."""
    for line in lines:
        if line.startswith("@RG"):
            for f in line.rstrip("\n").split("\t")[1:]:
                if f.startswith("SM:"):
                    return f[3:]
    return None


def blocks(raw: bytes) -> Iterator[bytes]:
    """Contents of a blocked gzip file's members, one after the other."""
    at = 0
    while at < len(raw):
        d = zlib.decompressobj(31)
        out = d.decompress(raw[at:]) + d.flush()
        at = len(raw) - len(d.unused_data)
        yield out


def _tag(b: bytes, i: int) -> tuple[str, str, int]:
    name, kind = b[i : i + 2].decode(), chr(b[i + 2])
    i += 3
    if kind in "ZH":
        end = b.index(b"\0", i)
        return name, b[i:end].decode(), end + 1
    if kind == "A":
        return name, chr(b[i]), i + 1
    codes = {"c": "<b", "C": "<B", "s": "<h", "S": "<H", "i": "<i", "I": "<I", "f": "<f"}
    if kind == "B":
        fmt, (n,) = codes[chr(b[i])], struct.unpack_from("<i", b, i + 1)
        size = struct.calcsize(fmt)
        return name, ",".join(str(struct.unpack_from(fmt, b, i + 5 + k * size)[0]) for k in range(n)), i + 5 + n * size
    (value,) = struct.unpack_from(codes[kind], b, i)
    return name, f"{value:g}" if kind == "f" else str(value), i + struct.calcsize(codes[kind])


def parse_bam(raw: bytes) -> tuple[list[str], Iterator[tuple]]:
    """Header lines and records of the binary form."""
    data = b"".join(blocks(raw))
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    (n,) = struct.unpack_from("<i", data, 4)
    lines, at = data[8 : 8 + n].rstrip(b"\0").decode().splitlines(), 8 + n
    (n_ref,) = struct.unpack_from("<i", data, at)
    at, names = at + 4, []
    for _ in range(n_ref):
        (k,) = struct.unpack_from("<i", data, at)
        names.append(data[at + 4 : at + 3 + k].decode())
        at += 8 + k

    def records(at: int) -> Iterator[tuple]:
        name_of = lambda i: names[i] if i >= 0 else None
        while at < len(data):
            (size,) = struct.unpack_from("<i", data, at)
            b = data[at + 4 : at + 4 + size]
            at += 4 + size
            ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mref, mpos, isize = struct.unpack_from("<iiBBHHHiiii", b)
            i = 32 + l_name
            ops = struct.unpack_from(f"<{n_ops}I", b, i)
            i += 4 * n_ops
            packed = b[i : i + (l_seq + 1) // 2]
            seq = "".join(LETTERS[c >> 4] + LETTERS[c & 15] for c in packed)[:l_seq]
            i += len(packed)
            q = b[i : i + l_seq]
            qual = "*" if not q or q[0] == 255 else "".join(chr(c + 33) for c in q)
            i += l_seq
            tags = {}
            while i < len(b):
                k, v, i = _tag(b, i)
                tags[k] = v
            yield b[32 : 31 + l_name].decode(), flag, name_of(ref), pos, mapq, "".join(f"{o >> 4}{OPS[o & 15]}" for o in ops) or "*", name_of(mref), mpos, isize, seq or "*", qual, tags

    return lines, records(at)


def parse_sam(text: str) -> tuple[list[str], Iterator[tuple]]:
    lines = text.splitlines()
    heads = [x for x in lines if x.startswith("@")]

    def records() -> Iterator[tuple]:
        for line in lines:
            if not line or line.startswith("@"):
                continue
            f = line.split("\t")
            chrom = None if f[2] == "*" else f[2]
            mate = chrom if f[6] == "=" else None if f[6] == "*" else f[6]
            tags = {t[:2]: t[5:] for t in f[11:] if len(t) >= 5}
            yield f[0], int(f[1]), chrom, int(f[3]) - 1, int(f[4]), f[5], mate, int(f[7]) - 1, int(f[8]), f[9], f[10], tags

    return heads, records()


@dataclass
class FilePart(InputPartition):
    path: str

    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class AlignmentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.paths = sorted(p for x in options["path"].split(",") for p in (glob.glob(x.removeprefix("file://")) or [x]))
        self.stem_only = options.get("samplefromname", "false") == "true"

    def partitions(self) -> list[FilePart]:
        return [FilePart(p) for p in self.paths]

    def read(self, partition: FilePart) -> Iterator[tuple]:
        path = partition.path
        if path.endswith(".cram"):
            raise ValueError("CRAM isn't supported: it needs a codec of its own; convert to BAM")
        with open(path, "rb") as f:
            raw = f.read()
        heads, records = parse_bam(raw) if raw[:2] == b"\x1f\x8b" else parse_sam(raw.decode())
        stem = path.rsplit("/", 1)[-1].split(".")[0]
        sample = stem if self.stem_only else header_sample(heads) or stem
        for r in records:
            yield path, sample, *r


class AlignmentSource(DataSource):
    """``spark.read.format("alignments").load("*.bam")``; a file is a partition, SAM or BAM by content."""

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> AlignmentReader:
        return AlignmentReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AlignmentSource)


def region(reads, chrom: str, start: int, end: int, margin: int = 0):
    """Reads that meet a 1-based inclusive region; the end comes from the CIGAR."""
    from pyspark.sql import functions as F

    from loomgrid.operators.pileup import cigar_ops

    span = F.aggregate(F.filter(cigar_ops(F.col("cigar")), lambda o: o.op.isin("M", "=", "X", "D", "N")), F.lit(0), lambda s, o: s + o.len)
    return reads.where((F.col("chrom") == chrom) & (F.col("pos0") < end + margin) & (F.col("pos0") + span >= start - margin))
