import gzip

import pytest
from pyspark.sql import functions as F

from strandloom.sources import fastx

FASTA = ">a one\nACGT\nAC\n\n>b\r\nGG \n>c x\nT"
FASTQ = "@r1 x\nACGT\n+\n@III\n@r2\nGG\n+r2\n>I\n"


def _rows(df):
    return [tuple(r) for r in df.orderBy("read_num").select("read_num", "header", "seq", "qual").collect()]


def test_fasta_of_any_line_length(spark, tmp_path):
    p = tmp_path / "a.fa"
    p.write_text(FASTA)
    want = [(0, ">a one", "ACGTAC", None), (1, ">b", "GG", None), (2, ">c x", "T", None)]
    assert _rows(fastx.read_sequences(spark, str(p))) == want
    z = tmp_path / "a.fa.gz"
    z.write_bytes(gzip.compress(FASTA[:18].encode()) + gzip.compress(FASTA[18:].encode()))
    assert fastx.sniff(spark, str(z)) == ("fasta", True)
    assert _rows(fastx.read_sequences(spark, str(z))) == want


def test_fastq_quality_may_look_like_a_header(spark, tmp_path):
    p = tmp_path / "a.fq"
    p.write_text(FASTQ)
    assert _rows(fastx.read_sequences(spark, str(p))) == [(0, "@r1 x", "ACGT", "@III"), (1, "@r2", "GG", ">I")]


def test_records_are_whole_over_many_partitions(spark, tmp_path):
    p, q = tmp_path / "a.fq", tmp_path / "a.fa"
    p.write_text("".join(f"@r{k}\n{'ACGT' * (k % 9 + 1)}\n+\n{'@' * (4 * (k % 9 + 1))}\n" for k in range(3000)))
    q.write_text("".join(f">r{k}\n{'ACGT' * (k % 9 + 1)}\n{'GG' * (k % 3)}\n" for k in range(3000)))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        fq, fa = fastx.read_sequences(spark, str(p)), fastx.read_sequences(spark, str(q))
        assert spark.read.text(str(q)).rdd.getNumPartitions() > 3
        got = fq.orderBy("read_num").collect()
        assert [r.header for r in got] == [f"@r{k}" for k in range(3000)] and all(len(r.seq) == len(r.qual) for r in got)
        got = fa.orderBy("read_num").collect()
        assert [(r.header, len(r.seq)) for r in got] == [(f">r{k}", 4 * (k % 9 + 1) + 2 * (k % 3)) for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)


def test_what_is_neither_is_refused(spark, tmp_path):
    p = tmp_path / "x"
    p.write_text("hello")
    with pytest.raises(ValueError, match="neither"):
        fastx.read_sequences(spark, str(p))


def test_mates(spark, tmp_path):
    a, b = tmp_path / "1.fq", tmp_path / "2.fq"
    a.write_text(FASTQ)
    b.write_text(FASTQ)
    two = fastx.read_reads(spark, [str(a), str(b)])
    assert fastx.unpaired(two).count() == 0
    assert sorted((r.pair_id, r.mate, r.read_id) for r in two.collect()) == [(0, 0, "0_0"), (0, 1, "1_0"), (1, 0, "0_1"), (1, 1, "1_1")]
    one = fastx.read_reads(spark, [str(a)], interleaved=True)
    assert sorted((r.pair_id, r.mate) for r in one.collect()) == [(0, 0), (0, 1)]
    assert fastx.unpaired(two.where("read_id <> '1_1'")).collect()[0].pair_id == 1


def test_stats(spark):
    reads = spark.createDataFrame([("ACGT",), ("AC",), ("A",)], "seq string")
    assert tuple(fastx.read_stats(reads).first()) == (3, 7, 1, 4, 2)
    assert tuple(fastx.read_stats(reads.limit(0)).first()) == (0, 0, None, None, None)
    assert fastx.too_long(reads, 2).count() == 1
    assert reads.select(F.length("seq")).count() == 3
