"""Search of reads as their files arrive: an extension, with statistics frozen beforehand.

E-values need the totals of reads and references, so a stream is given score statistics
of an expected volume; each micro-batch then is an ordinary search whose alignments are
appended to a Parquet table, once for each batch number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from strandloom.config import SearchConfig
from strandloom.functions.stats import ScoreStats
from strandloom.operators.index import SeedIndex
from strandloom.plans.search import Search


def search_arrivals(reads: DataFrame, index: SeedIndex, config: SearchConfig, stats: dict[int, ScoreStats], out: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Starts the stream. reads: a streaming DataFrame with read_id and seq."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        try:
            search = Search(rows, index.refs, config, index)
            search._stats = stats
            search.alignments().write.mode("overwrite").parquet(f"{out}/batch={number}")
        finally:
            rows.unpersist()

    writer = reads.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
