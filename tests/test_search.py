"""Whole searches over small files, against known results and a plain search."""

import gzip
import random

import pytest
from golden import LONG_CIGAR, LONG_ROW, LONG_SCORE, SHORT_SAM, sequences

from strandloom.config import SearchConfig
from strandloom.operators import index, select
from strandloom.operators.align import encoded
from strandloom.plans.search import Search, explain_seed
from strandloom.sources import fastx, reports


def _fasta(path, records, width=60):
    path.write_text("".join(f">{h}\n" + "".join(f"{s[k : k + width]}\n" for k in range(0, len(s), width)) for h, s in records))
    return str(path)


def _rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_long_read_row(spark, tmp_path):
    s = sequences()
    reads = fastx.read_reads(spark, [_fasta(tmp_path / "r.fa", [("q1 some words", s["long_read"])])])
    refs = fastx.references(spark, [_fasta(tmp_path / "d.fa", [("ref1 x", s["long_reference"])])])
    search = Search(reads, refs, SearchConfig(gumbel=(0.59, 0.33))).checked()
    found = search.alignments()
    a = found.collect()
    assert [(x.score, x.cigar, x.strand) for x in a] == [(LONG_SCORE, LONG_CIGAR, True)]
    row = reports.blast_columns(found, reads, refs, search.stats()[0]).first().asDict()
    assert {k: (reports.significant(row[k]) if k == "pident" else row[k]) for k in LONG_ROW} == LONG_ROW
    line = reports.blast_lines(reports.blast_columns(found, reads, refs, search.stats()[0]), ("1", "cigar", "qstrand")).first().line
    assert line.split("\t")[:4] == ["q1", "ref1", "93.5", "1430"] and line.endswith(f"57S{LONG_CIGAR}\t+")
    text = reports.pairwise_lines(found, reads, refs, search.stats()[0]).first().line
    assert text.startswith("Sequence ID: ref1\nQuery ID: q1\nScore: 2430 bits (2069)\tExpect: 0\tstrand: +\n")


def test_both_strands_of_one_reference(spark, tmp_path):
    read = sequences()["short_read"]
    reads = fastx.read_reads(spark, [_fasta(tmp_path / "r.fa", [("a", read)])])
    refs = fastx.references(spark, [_fasta(tmp_path / "d.fa", [("b", read + _rc(read))])])
    search = Search(reads, refs, SearchConfig(num_alignments=0, gumbel=(0.6, 0.33)))
    found = search.alignments()
    rows = reports.sam_rows(found, reads, refs).collect()
    assert {(r.flag, r.pos, r.cigar, r["as"], r.nm) for r in rows} == SHORT_SAM
    assert {r.seq for r in rows} == {read, _rc(read)}
    assert explain_seed(search, "0_0", 0).count() >= 1


def _set(seed=2, n=24):
    rng = random.Random(seed)
    dna = lambda k: "".join(rng.choices("ACGT", k=k))
    refs = [(f"r{k}", dna(300)) for k in range(6)]
    refs += [("r6", refs[0][1][:150] + dna(150))]
    reads = []
    for k in range(n):
        if k % 3 == 2:
            reads.append((f"q{k}", dna(100)))
            continue
        base = rng.choice(refs)[1]
        at = rng.randrange(200)
        own = list(base[at : at + 100])
        for _ in range(rng.randrange(4)):
            own[rng.randrange(100)] = rng.choice("ACGT")
        own = "".join(own)
        reads.append((f"q{k}", _rc(own) if k % 2 else own))
    return reads, refs


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("search")
    reads, refs = _set()
    r, d = _fasta(folder / "r.fa", reads), _fasta(folder / "d.fa", refs)
    return fastx.read_reads(spark, [r]), fastx.references(spark, [d])


def test_hits_are_those_reads_that_come_from_references(small):
    reads, refs = small
    c = SearchConfig(gumbel=(0.62, 0.4), evalue=1e-3)
    counts = {}
    for n in (1, 3, 0):
        found = Search(reads, refs, c.with_(num_alignments=n)).alignments().collect()
        counts[n] = len(found)
        assert {x.read_id for x in found} == {f"0_{k}" for k in range(24) if k % 3 != 2}
    assert counts[1] == 16 and counts[1] <= counts[3] <= counts[0]
    first = Search(reads, refs, c.with_(best=False)).alignments().collect()
    assert len(first) == 16


def test_alignments_do_not_depend_on_partitions(small, spark):
    reads, refs = small
    c = SearchConfig(gumbel=(0.62, 0.4))
    one = sorted(map(tuple, Search(reads.coalesce(1), refs, c).alignments().collect()))
    many = sorted(map(tuple, Search(reads.repartition(7), refs.repartition(3), c, small=False).alignments().collect()))
    assert one == many


def test_index_round_trip(small, spark, tmp_path):
    reads, refs = small
    c = SearchConfig(gumbel=(0.62, 0.4))
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        index.ensure(refs, c, path, mode=0)
    ix = index.ensure(refs, c, path)
    assert index.ready(spark, path)
    again = index.ensure(refs, c, path, mode=0)
    assert again.forward.count() == ix.forward.count()
    want = sorted(map(tuple, Search(reads, refs, c).alignments().collect()))
    assert sorted(map(tuple, Search(reads, refs, c, again).alignments().collect())) == want


def test_short_reference_is_refused(spark, tmp_path):
    refs = fastx.references(spark, [_fasta(tmp_path / "d.fa", [("ok", "ACGT" * 10), ("ref_short", "ACGTACGTACGTAC")])])
    with pytest.raises(ValueError, match="shorter than the seed length 19"):
        index.check_lengths(refs, SearchConfig())


def test_long_read_is_refused(small):
    with pytest.raises(ValueError, match="longer than 50"):
        Search(*small, SearchConfig(max_read_len=50)).checked()


def test_reports_are_written(small, spark, tmp_path):
    reads, refs = small
    c = SearchConfig(gumbel=(0.62, 0.4), evalue=1e-3, fastx=True, other=True, sam=True, sam_sq=True, blast=("1", "cigar"), print_all_reads=True, otu_map=True, de_novo=True, min_id=0.95, min_cov=0.9)
    search = Search(reads, refs, c)
    found = search.alignments()
    search.write(found, str(tmp_path / "out"), "run", zipped=True)
    text = lambda *p: [line for f in sorted((tmp_path / "out").joinpath(*p).rglob("part-*")) for line in (gzip.decompress(f.read_bytes()).decode() if f.suffix == ".gz" else f.read_text()).splitlines()]
    assert len(text("reads", "output=aligned")) == 32 and len(text("reads", "output=other")) == 16
    assert len(text("blast", "db=0")) == 16 and len(text("blast", "missed")) == 8
    assert [x.split("\t")[0] for x in text("sam", "header")] == ["@HD", *["@SQ"] * 7, "@PG"]
    assert len(text("sam", "rows")) == 24
    marked = search.marked(found)
    assert sum(len(x.split("\t")) - 1 for x in text("otu_map")) == marked.where("class = 'id_cov'").count()
    log = "\n".join(text("log"))
    assert "Total reads = 24" in log and "passing E-value threshold = 16 (66.67)" in log and f"Total OTUs = {select.otu_total(marked).first().otus}" in log


def test_letters():
    assert encoded("acgtuNx").tolist() == [0, 1, 2, 3, 3, 4, 4]


def test_pairs_without_a_mate_are_refused(spark):
    reads = spark.createDataFrame([("0_0", 0, 0, "ACGT" * 10), ("1_0", 0, 1, "ACGT" * 10), ("0_1", 1, 0, "ACGT" * 10)], "read_id string, pair_id long, mate int, seq string")
    refs = spark.createDataFrame([(0, 0, "r", ">r", "ACGTTGCA" * 10)], "db int, ref_num long, ref_id string, header string, seq string")
    with pytest.raises(ValueError, match="pair 1 has 1 reads"):
        Search(reads, refs, SearchConfig(paired=True, gumbel=(0.6, 0.33))).checked()
    assert Search(reads.where("pair_id = 0"), refs, SearchConfig(paired=True, gumbel=(0.6, 0.33))).checked()
