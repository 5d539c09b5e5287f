import random

from strandloom.config import SearchConfig
from strandloom.functions.stats import ScoreStats
from strandloom.operators.index import SeedIndex
from strandloom.streaming.arrivals import search_arrivals


def test_arriving_reads_are_searched_once(spark, tmp_path):
    rng = random.Random(7)
    ref = "".join(rng.choices("ACGT", k=300))
    refs = spark.createDataFrame([(0, 0, "r0", ">r0", ref)], "db int, ref_num long, ref_id string, header string, seq string")
    schema = "read_id string, seq string"
    spark.createDataFrame([("a", ref[20:120]), ("b", "".join(rng.choices("ACGT", k=100)))], schema).write.parquet(str(tmp_path / "in"))
    c = SearchConfig(gumbel=(0.6, 0.3))
    reads = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = search_arrivals(reads, SeedIndex.of(refs, c), c, {0: ScoreStats(0.6, 0.3, 2.0, 300, 200, 40)}, str(tmp_path / "out"), str(tmp_path / "check"), available_now=True)
    q.awaitTermination(180)
    assert q.exception() is None
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.read_id, r.score) for r in rows] == [("a", 200)]
