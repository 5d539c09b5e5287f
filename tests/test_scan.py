"""The Arrow pass over the reads gives the hits of the joins, and makes no row of a window."""

import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from strandloom import tables
from strandloom.config import SearchConfig
from strandloom.functions import encode
from strandloom.operators import align, candidates, index, scan, seeds, select
from strandloom.plans import bindings

TABLES = "/root/testdata/sf0.001"


def _tables(spark, seed, alphabet="ACGT", own=1):
    """References of two databases, and reads with copies of them: edited, in small letters, in other letters, of one id."""
    rng = random.Random(seed)
    dna = lambda n: "".join(rng.choices(alphabet, k=n))
    refs = [(db, k, dna(rng.choice((19, 30, 120)))) for db in (0, 1) for k in range(8)]
    reads = [(0, None), (1, ""), (2, "ACGT" * 4), (3, "acgu" * 20), (4, "NRYé" * 9 + refs[0][2] + "ß" + refs[1][2])]
    for k in range(5, 60):
        text = list(dna(rng.randrange(40)) + rng.choice(refs)[2] + dna(rng.randrange(40)))
        for _ in range(rng.randrange(8)):
            at = rng.randrange(len(text))
            text[at : at + rng.randrange(2)] = rng.choices(alphabet + "Nß", k=rng.randrange(3))
        text = "".join(text)
        if k % 3 == 0:
            text = text[::-1].translate(str.maketrans("ACGT", "TGCA"))
        reads.append((k // own, text.lower() if k % 7 == 0 else text))
    return spark.createDataFrame(reads, "read_id long, seq string").repartition(3), spark.createDataFrame(refs, "db int, ref_num long, seq string")


def _rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("seed", "alphabet", "own"), [(18, "ACGT", 1), (18, "AC", 2), (12, "AT", 1), (8, "ACGT", 3), (22, "CG", 1)])
def test_pass_gives_the_hits_of_the_joins(spark, seed, alphabet, own):
    reads, refs = _tables(spark, seed, alphabet, own)
    some = 0
    for c in (SearchConfig(seed=seed), SearchConfig(seed=seed, full_search=True), SearchConfig(seed=seed, reverse=False, passes=(4, 2, 1))):
        ix = index.SeedIndex.of(refs, c)
        for upto in range(3):
            want = _rows(seeds.search(reads, ix, c, False, upto))
            assert _rows(seeds.search(reads, ix, c, True, upto)) == want
            some += len(want)
        for back in (False, True):
            assert _rows(seeds.search_side(reads, ix, c, back, True)) == _rows(seeds.search_side(reads, ix, c, back, False))
    assert some > 100


def test_pass_in_small_steps_gives_the_same(spark, monkeypatch):
    reads, refs = _tables(spark, 5, "AC")
    c = SearchConfig()
    ix = index.SeedIndex.of(refs, c)
    sent = scan.tables(ix, c, True, True).value
    key, pattern = scan.halves(scan.letters_of(scan.pa.array(["AC" * 50]))[0], scan.np.arange(80), 9)
    whole = [x.tolist() for x in sent[0][0].hits(key, pattern)]
    monkeypatch.setattr(scan, "PAIRS", 1)
    assert [x.tolist() for x in sent[0][0].hits(key, pattern)] == whole
    empty = index.SeedIndex.of(refs.limit(0), c)
    assert seeds.search(reads, empty, c, True).count() == 0


def test_windows_are_no_rows(spark):
    plan = lambda name: contract.queries()[name](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    for name in ("seed_hits_both_strands", "seed_hits_full", "seeded_reads", "seed_lev1_fwd", "seed_lev1_rev"):
        text = plan(name)
        assert "MapInArrow" in text and " AS w1" not in text and "Join" not in text, name


def test_reads_with_rows_alone_go_on(spark, tmp_path, monkeypatch):
    spark.range(5).select(F.col("id").alias("read_id"), F.lit(1).alias("x")).unionByName(spark.createDataFrame([(3, 2)], "read_id long, x int")).write.parquet(f"{tmp_path}/found")
    found, reads = spark.read.parquet(f"{tmp_path}/found"), spark.range(100).select(F.col("id").alias("read_id"))
    assert _rows(select.among(reads, found)) == [(k,) for k in range(5)]
    monkeypatch.setattr(select, "FEW_READS", 2)
    assert _rows(select.among(reads, found)) == [(k,) for k in range(5)]


def test_alignments_are_dealt_to_several_tasks(spark):
    reads, refs = _tables(spark, 3)
    c = SearchConfig(gumbel=(0.6, 0.33))
    reads = reads.where("seq IS NOT NULL").withColumn("read_id", F.col("read_id").cast("string"))
    ix = index.SeedIndex.of(refs, c)
    places = tables.written(seeds.placed(seeds.search(reads, ix, c, True, 0), ix), "places")
    found = align.alignments(places, reads, refs, candidates.candidate_refs(places, c), c, {0: 20, 1: 20})
    assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_a_read_stays_together_when_partitions_are_joined_at_run_time(spark):
    """Both sides of a union join small partitions each in its own way, so a read's rows are dealt out after the union."""
    reads, refs = _tables(spark, 3)
    c = SearchConfig(gumbel=(0.6, 0.33))
    reads = tables.written(reads.where("seq IS NOT NULL").withColumn("read_id", F.col("read_id").cast("string")), "reads")
    ix = index.SeedIndex.of(refs, c)
    places = tables.written(seeds.placed(seeds.hits(seeds.windows(seeds.strands(reads, c), c), ix, c, True), ix), "places")
    found = lambda: _rows(align.alignments(places, reads, F.broadcast(refs), candidates.candidate_refs(places, c), c, {0: 20, 1: 20}))
    want = found()
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "500b"}
    before = {k: spark.conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        assert found() == want
        assert len(want) > 5
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


ODD = [(0, None), (1, ""), (2, "1 2é\x00[@`{ß"), (3, "Az" * 20 + "K"), (4, "ſtraße ÄB\nc d 😀e"), (5, "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ")]


def test_letters_of_bare_texts(spark):
    """From bytes as by ``text_sequence``: no letter beyond A to Z counts, whatever its capital is."""
    made = {r["k"]: r["seq"] for r in spark.createDataFrame(ODD, "k int, text string").select("k", encode.text_sequence(F.col("text")).alias("seq")).collect()}
    texts = scan.pa.array([t for _, t in ODD])
    for own in (texts, texts.slice(3), texts.slice(2, 0)):
        letters, ends = scan.text_letters(own)
        want = [made[k] or "" for k, t in ODD if t in own.to_pylist()] if len(own) else []
        assert ["".join("ACGT"[x] for x in letters[a:b]) for a, b in zip(ends, ends[1:], strict=False)] == want


@pytest.mark.parametrize("full", [False, True])
def test_pass_over_bare_texts_gives_the_same_hits(spark, full):
    reads, refs = _tables(spark, 3)
    c = SearchConfig(full_search=full)
    ix = index.SeedIndex.of(refs, c)
    # b is a C in turn, and e an A; other characters between letters do not count
    texts = reads.withColumn("seq", F.regexp_replace(F.translate("seq", "ACac", "ebEB"), "G", "g 1é"))
    made = texts.select("read_id", encode.text_sequence(F.col("seq")).alias("seq"))
    want = _rows(seeds.search(made, ix, c, False))
    assert len(want) > 50 and _rows(seeds.search(texts, ix, c, True, coded=scan.text_letters)) == want
    for back in (False, True):
        assert _rows(seeds.search_side(texts, ix, c, back, True, scan.text_letters)) == _rows(seeds.search_side(made, ix, c, back, False))


def test_seed_pass_takes_letters_from_bytes(spark):
    """Letters were rewritten one by one in the plan, for most of the pass's time."""
    for name in ("seed_hits_both_strands", "seed_hits_full", "seeded_reads", "seed_lev1_fwd", "seed_lev1_rev"):
        text = contract.queries()[name](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" in text and "regexp_replace" not in text and "translate" not in text, name


def test_only_the_letters_opposite_a_reference_go_on(spark):
    rows = bindings._sized(spark, TABLES, True)[2]
    assert rows.where("length(seq) > length(ref_seq)").count() == 0
    whole = bindings._stranded(bindings.reads(spark, TABLES)).select("read_id", "strand", F.col("seq").alias("own"), F.col("read_len").alias("n"))
    both = rows.join(whole, ["read_id", "strand"])
    some = both.where("pos < win AND n > length(ref_seq)").count()
    assert some and both.where("read_len <> n OR NOT startswith(substring(own, CAST(greatest(0, win - pos) AS INT) + 1, n), seq)").count() == 0
    # an alignment beyond the reference's end would lack letters
    assert both.where("length(seq) < least(length(ref_seq), n - greatest(0, win - pos))").count() == 0


def test_lengths_of_texts(spark):
    """Whole texts were rewritten letter by letter for their lengths."""
    rows = spark.createDataFrame(ODD, "read_id int, seq string").repartition(2)
    want = _rows(rows.select("read_id", F.length(encode.text_sequence(F.col("seq"))).alias("n")))
    assert sorted(map(tuple, scan.lengths(rows).collect())) == want and want[0][1] is None
    plan = contract.queries()["read_stats"](spark, TABLES)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_replace" not in plan


def test_letters_opposite_a_reference_come_from_bytes(spark):
    """As cut from the rewritten strands, for copies of an id and places beyond a text's end, too."""
    texts = spark.createDataFrame([(k, t) for k, t in ODD] + [(3, "bcd " * 9)], "read_id long, seq string")
    places = [(k, strand, 7 * k, pos, win, n) for k, _ in ODD for strand in (True, False) for pos, win, n in ((0, 0, 9), (3, 1, 40), (1, 8, 5), (0, 30, 20), (0, 90, 20), (2, 2, 0))]
    rows = spark.createDataFrame(places, "read_id long, strand boolean, ref_num long, pos int, win int, ref_len int")
    asked = rows.groupBy("read_id").agg(F.collect_list(F.struct("strand", "ref_num", "pos", "win", "ref_len")).alias("places"))
    made = bindings._stranded(texts.withColumn("seq", encode.text_sequence(F.col("seq"))).where("seq IS NOT NULL"))
    cut = F.substring(F.col("seq"), F.greatest(F.lit(0), F.col("win") - F.col("pos")) + 1, F.col("ref_len"))
    want = _rows(rows.join(made, ["read_id", "strand"]).select("read_id", "strand", "ref_num", "pos", "win", "ref_len", "read_len", cut))
    got = scan.opposite(texts.where("seq IS NOT NULL").join(asked, "read_id"))
    assert len(want) == 72 and _rows(got) == want


def test_reads_of_candidates_are_not_rewritten(spark):
    """Spark rewrote the letters of candidates' reads and turned them, for most of that pass's time."""
    for first in (True, False):
        text = bindings._sized(spark, TABLES, first)[2].select("read_id", "read_len")._jdf.queryExecution().optimizedPlan().toString()
        reads = [x for x in text.splitlines() if "regexp_replace(text" in x and "doc_id" in x]
        assert "MapInArrow" in text and not reads and "reverse(" not in text
