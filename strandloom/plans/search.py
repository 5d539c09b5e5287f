"""A whole search: reads against references, to alignments, classes and reports."""

from __future__ import annotations

from dataclasses import astuple, dataclass, fields

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.config import SearchConfig
from strandloom.functions.stats import ScoreStats, score_stats
from strandloom.operators import align, candidates, routing, seeds, select
from strandloom.operators.index import SeedIndex, background, totals
from strandloom.sources import fastx, reports
from strandloom.tables import written


@dataclass
class Search:
    """reads: read_id, seq (header, qual, mate and pair_id for reports). refs: db, ref_num, ref_id, header, seq."""

    reads: DataFrame
    refs: DataFrame
    config: SearchConfig
    index: SeedIndex | None = None
    small: bool | None = None

    def __post_init__(self):
        if self.index is None:
            made = SeedIndex.of(self.refs, self.config)
            self.index = SeedIndex(self.refs, *(written(t, "index") for t in (made.forward, made.back, made.places)))
        if self.small is None:
            self.small = self.index.forward.limit(seeds.BROADCAST_ROWS + 1).count() <= seeds.BROADCAST_ROWS
        self._stats: dict[int, ScoreStats] | None = None

    def checked(self) -> Search:
        """This search, once no read is over the length limit and, in a paired search, every read has its mate."""
        long = fastx.too_long(self.reads, self.config.max_read_len).select("read_id").first()
        if long is not None:
            raise ValueError(f"read {long['read_id']} is longer than {self.config.max_read_len}")
        if self.config.paired and "pair_id" in self.reads.columns:
            alone = fastx.unpaired(self.reads.where(F.col("pair_id").isNotNull())).first()
            if alone is not None:
                raise ValueError(f"pair {alone['pair_id']} has {alone['reads']} reads, of {alone['mates']} mates")
        return self

    def stats(self) -> dict[int, ScoreStats]:
        """Score statistics of each database: two small aggregations, once."""
        if self._stats is None:
            n = fastx.read_stats(self.reads).first()
            counts: dict[int, dict[str, int]] = {}
            for r in background(self.refs).collect():
                counts.setdefault(r["db"], {})[r["nt"]] = r["n"]
            self._stats = {}
            for t in totals(self.refs).collect():
                letters = counts[t["db"]]
                freqs = {b: c / max(1, sum(letters.values())) for b, c in letters.items()}
                self._stats[t["db"]] = score_stats(freqs, t["total_len"], t["n_refs"], n["total_len"], n["reads"], self.config)
        return self._stats

    def save_stats(self, path: str) -> None:
        """Writes the statistics as one JSON line for each database, so that a report of another run takes them up."""
        rows = [(db, *astuple(x)) for db, x in self.stats().items()]
        names = ["db", *(f.name for f in fields(ScoreStats))]
        self.reads.sparkSession.createDataFrame(rows, names).coalesce(1).write.mode("overwrite").json(path)

    def load_stats(self, path: str) -> Search:
        names = [f.name for f in fields(ScoreStats)]
        self._stats = {r["db"]: ScoreStats(*(r[n] for n in names)) for r in self.reads.sparkSession.read.json(path).collect()}
        return self

    def alignments(self, keep=written) -> DataFrame:
        """The alignments kept of each read, pass after pass: a later pass takes up what is left.

        keep: writes a pass's hits and alignments and reads them again, so that a later
        pass's plan starts from tables.
        """
        config, least = self.config, {db: s.minimal_score for db, s in self.stats().items()}
        # read, spread and letters only once, however many passes there are
        left = keep(seeds.spread(self.reads.select("read_id", "seq").where(F.length("seq") >= config.seed)), "reads")
        earlier, out = None, None
        for k in range(len(config.steps)):
            hits = seeds.search(left, self.index, config, self.small, k)
            hits = keep(hits if earlier is None else hits.unionByName(earlier), f"hits-{k}")
            ready = hits.join(seeds.seeded_reads(hits, config).select("db", "read_id", "strand"), ["db", "read_id", "strand"], "left_semi")
            places = keep(seeds.placed(ready, self.index), f"places-{k}")
            # only reads that may align are dealt out
            asked = keep(select.among(left, places), f"asked-{k}")
            mine = align.alignments(places, asked, self.refs, candidates.candidate_refs(places, config), config, least)
            mine = keep(mine, f"alignments-{k}")
            out = mine if out is None else out.unionByName(mine)
            if k < len(config.steps) - 1:
                done = select.ids_of(mine)
                left = keep(left.join(done, "read_id", "left_anti"), "reads")
                earlier = hits.join(done, "read_id", "left_anti")
        return select.kept(out, config)

    def marked(self, found: DataFrame) -> DataFrame:
        """Alignments with ratios, classes and reference names."""
        named = found.join(self.refs.select("db", "ref_num", "ref_id"), ["db", "ref_num"])
        return select.classed(select.with_ratios(named), self.config)

    def summary(self, found: DataFrame) -> dict:
        """One row of totals, and per-database counts."""
        s = fastx.read_stats(self.reads).first().asDict()
        s["aligned"] = found.select("read_id").distinct().count()
        s["minimal_score"] = ",".join(str(x.minimal_score) for _, x in sorted(self.stats().items()))
        marked = self.marked(found)
        s["denovo"] = select.denovo_reads(marked).count()
        s["id_cov"] = select.class_counts(marked).first()["n_id_cov"]
        s["otus"] = select.otu_total(marked).first()["otus"]
        s["per_db"] = [(r["db"], r["first_hits"]) for r in select.per_db(found).orderBy("db").collect()]
        return s

    def write(self, found: DataFrame, folder: str, command: str = "", zipped: bool = False, run: dict | None = None) -> None:
        """All reports that the options ask for, under ``folder``. run: what the log says of the run."""
        c = self.config
        zipped = c.zipped(zipped)
        missed = select.other(self.reads, found)
        rated = select.with_ratios(found)
        if c.fastx or c.de_novo:
            routed = routing.routes(routing.with_hits(self.reads, found), c) if c.paired else routing.routes(self.reads.join(found.select("read_id").distinct().withColumn("hit", F.lit(True)), "read_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False))).withColumns({"h0": F.col("hit"), "h1": F.lit(False)}), c)
            if c.fastx:
                wanted = routed if c.other else routed.where("output = 'aligned'")
                reports.save_lines(reports.fastx_lines(wanted), f"{folder}/reads", zipped, ("output", "file"))
            if c.de_novo:
                own = routing.denovo_routes(routed, select.denovo_reads(self.marked(found)), c)
                reports.save_lines(reports.fastx_lines(own), f"{folder}/denovo", False, ("file",))
        tabular = c.blast if c.blast is not None else None if c.fastx or c.sam or c.otu_map or c.de_novo else ("1",)
        if tabular is not None:
            for db, stats in self.stats().items():
                mine = rated.where(F.col("db") == db)
                if "0" in tabular:
                    lines = reports.pairwise_lines(mine, self.reads, self.refs, stats)
                else:
                    lines = reports.blast_lines(reports.blast_columns(mine, self.reads, self.refs, stats), tabular)
                reports.save_lines(lines, f"{folder}/blast/db={db}", zipped)
            if c.print_all_reads:
                reports.save_lines(reports.null_rows(missed, tabular), f"{folder}/blast/missed", zipped)
        if c.sam:
            rows = reports.sam_rows(rated, self.reads, self.refs)
            if c.print_all_reads:
                rows = rows.unionByName(reports.sam_null_rows(missed))
            head = reports.sam_header(self.refs, command, c.sam_sq).orderBy("ord").select("line").coalesce(1)
            reports.save_lines(head, f"{folder}/sam/header", zipped)
            reports.save_lines(reports.sam_lines(rows), f"{folder}/sam/rows", zipped)
        if c.otu_map:
            reports.save_lines(reports.otu_lines(select.otu_map(self.marked(found).join(self.reads.select("read_id", "header"), "read_id"))), f"{folder}/otu_map", False)
        text = reports.summary_text(self.summary(found), c, {"command": command} | (run or {}))
        log = self.reads.sparkSession.range(1).select(F.lit(text.rstrip("\n")).alias("line"))
        reports.save_lines(log, f"{folder}/log", False)


def explain_seed(search: Search, read_id: str, win: int) -> DataFrame:
    """The seed hits of one window of one read, with their places: a debugging aid."""
    one = search.reads.where(F.col("read_id") == read_id)
    cut = seeds.windows(seeds.strands(one, search.config), search.config.with_(passes=(1, 1, 1)), 0).where(F.col("win") == win)
    return seeds.placed(seeds.hits(cut, search.index, search.config, search.small), search.index)
