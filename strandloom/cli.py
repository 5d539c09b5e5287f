"""Command line: ``python -m strandloom -ref db.fa -reads reads.fq -workdir run ...``

Tasks: 0 align, 1 summary from stored alignments, 2 reports from stored alignments,
3 align and summary, 4 all. ``-index 1`` builds the index and stops. Alignments are
stored as Parquet under the work folder, so that later tasks need no new search.
"""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.config import SearchConfig
from strandloom.operators import index
from strandloom.plans.search import Search
from strandloom.sources import fastx, reports

VERSION = "1.0"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="strandloom", allow_abbrev=False, add_help=False)
    flag = lambda *names: p.add_argument(*names, action="store_true")
    text = lambda name, **k: p.add_argument(name, **k)
    text("-ref", action="append", default=[])
    text("-reads", action="append", default=[])
    for name, value in (("-workdir", "run"), ("-kvdb", None), ("-idx-dir", None), ("-readb", None), ("-aligned", None), ("-other", None), ("-blast", None), ("-edges", "4"), ("-passes", None), ("-cmd", None)):
        if name == "-other":
            p.add_argument(name, nargs="?", const="", default=value)
        else:
            text(name, default=value)
    for name, value in (("-readfeed", 0), ("-num_alignments", None), ("-min_lis", None), ("-zip-out", -1), ("-match", 2), ("-mismatch", -3), ("-gap_open", 5), ("-gap_ext", 2), ("-N", None), ("-max_read_len", 30_000), ("-num_seeds", 2), ("-threads", 2), ("-a", None), ("-index", 2), ("-L", 18), ("-interval", 1), ("-max_pos", 10_000), ("-task", 4), ("-dbg-level", 0), ("-dbg_put_db", 0)):
        text(name, type=int, default=value)
    for name, value in (("-e", 1.0), ("-id", None), ("-coverage", None), ("-m", 3072.0), ("-lambda", None), ("-K", None)):
        text(name, type=float, default=value)
    for name in ("-fastx", "-sam", "-SQ", "-no-best", "-print_all_reads", "-paired", "-paired_in", "-paired_out", "-out2", "-sout", "-F", "-R", "-score_split", "-de_novo_otu", "-otu_map", "-full_search", "-pid", "-v", "-h", "-version"):
        flag(name)
    return p


def config_of(o: argparse.Namespace) -> SearchConfig:
    """The options as a SearchConfig; raises ValueError where they do not go together."""
    blast = tuple(o.blast.split()) if o.blast is not None else None
    get = lambda name: getattr(o, name.replace("-", "_"))
    bad = []
    if not o.ref:
        bad.append("-ref is required")
    if not 1 <= len(o.reads) <= 2 and o.index != 1:
        bad.append("-reads takes one or two files")
    if o.min_lis is not None and o.num_alignments is not None:
        bad.append("-min_lis excludes -num_alignments")
    if o.min_lis is not None and get("no-best"):
        bad.append("-min_lis needs best alignments")
    if (o.id is not None or o.coverage is not None) and not o.otu_map:
        bad.append("-id and -coverage need -otu_map")
    if o.num_alignments is not None and not (o.fastx or o.sam or blast):
        bad.append("-num_alignments needs an output format")
    if not 0 <= o.task <= 4:
        bad.append("-task takes 0 to 4")
    if o.index not in (0, 1, 2):
        bad.append("-index takes 0, 1 or 2")
    if (getattr(o, "lambda") is None) != (o.K is None):
        bad.append("-lambda and -K go together")
    if bad:
        raise ValueError("; ".join(bad))
    one_side = o.F != o.R
    return SearchConfig(
        seed=o.L, passes=tuple(int(x) for x in o.passes.split(",")) if o.passes else None, interval=o.interval, max_pos=o.max_pos, part_mb=o.m, num_seeds=o.num_seeds, min_lis=o.min_lis or 2, full_search=o.full_search,
        max_read_len=o.max_read_len, forward=not one_side or o.F, reverse=not one_side or o.R, match=o.match, mismatch=o.mismatch, gap_open=o.gap_open, gap_ext=o.gap_ext, score_n=o.N, evalue=o.e, gumbel=(getattr(o, "lambda"), o.K) if o.K is not None else None,
        score_split=o.threads if o.score_split else 1, edges=o.edges, num_alignments=1 if o.num_alignments is None else o.num_alignments, best=not get("no-best"), min_id=o.id, min_cov=o.coverage, otu_map=o.otu_map, de_novo=o.de_novo_otu,
        fastx=o.fastx, other=o.other is not None, sam=o.sam, sam_sq=o.SQ, blast=blast, print_all_reads=o.print_all_reads, paired=o.paired or o.paired_in or o.paired_out or len(o.reads) == 2, paired_in=o.paired_in, paired_out=o.paired_out, out2=o.out2, sout=o.sout and (o.paired or len(o.reads) == 2), zip_out=o.zip_out,
    )


def run(argv: list[str], spark: SparkSession | None = None) -> DataFrame | None:
    """Runs the tasks asked for and returns the alignments."""
    o = parser().parse_args(argv)
    if o.h:
        print(parser().format_usage(), end="")
        return None
    if o.version:
        print(f"strandloom {VERSION}")
        return None
    c = config_of(o)
    began = time.time()
    own = spark or SparkSession.builder.appName("strandloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    work = o.workdir.rstrip("/")
    refs = fastx.references(own, o.ref)
    ix = index.ensure(refs, c, o.idx_dir or f"{work}/idx", o.index)
    if o.index == 1:
        return None
    reads = fastx.read_reads(own, o.reads, c.paired and len(o.reads) == 1)
    zipped = fastx.sniff(own, o.reads[0])[1]
    search = Search(reads, refs, c, ix).checked()
    store = o.kvdb or f"{work}/kvdb"
    # a report of an earlier search takes its statistics, not those of the reads given now
    if o.task in (0, 3, 4):
        search.alignments().write.mode("errorifexists").parquet(store)
        search.save_stats(f"{store}-stats")
    else:
        search.load_stats(f"{store}-stats")
    found = own.read.parquet(store)
    folder = o.aligned or f"{work}/out"
    command = " ".join(argv)
    about = lambda: {"command": command, "references": o.ref, "reads": o.reads, "finished": time.strftime("%Y-%m-%d %H:%M:%S"), "seconds": time.time() - began}
    if o.task in (2, 4):
        search.write(found, folder, command, zipped, about())
    elif o.task in (1, 3):
        text = reports.summary_text(search.summary(found), c, about())
        reports.save_lines(own.range(1).select(F.lit(text.rstrip("\n")).alias("line")), f"{folder}/log")
    return found


def main() -> int:
    try:
        run(sys.argv[1:])
    except (ValueError, FileNotFoundError) as e:
        print(f"strandloom: {e}", file=sys.stderr)
        return 1
    return 0
