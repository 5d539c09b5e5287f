import random

import pytest

from strandloom import cli


def _files(folder):
    rng = random.Random(3)
    ref = "".join(rng.choices("ACGT", k=400))
    (folder / "d.fa").write_text(f">r0 x\n{ref}\n")
    (folder / "r.fa").write_text("".join(f">q{k}\n{ref[40 * k : 40 * k + 80]}\n" for k in range(5)) + f">n\n{''.join(rng.choices('ACGT', k=80))}\n")
    return str(folder / "d.fa"), str(folder / "r.fa")


def test_align_then_report_from_what_is_stored(spark, tmp_path):
    d, r = _files(tmp_path)
    args = ["-ref", d, "-reads", r, "-workdir", str(tmp_path / "w"), "-lambda", "0.6", "-K", "0.3", "-e", "1e-3", "-fastx", "-other", "-sam", "-blast", "1 cigar"]
    assert cli.run([*args, "-index", "1"], spark) is None
    found = cli.run([*args, "-index", "0", "-task", "3"], spark)
    assert sorted(x.read_id for x in found.collect()) == [f"0_{k}" for k in range(5)]
    log = "".join(p.read_text() for p in (tmp_path / "w/out/log").glob("part-*"))
    assert "Total reads = 6" in log and "Command: -ref" in log and f"    {r}" in log and "seconds" in log
    assert len(list((tmp_path / "w/kvdb-stats").glob("part-*"))) == 1
    cli.run([*args, "-index", "0", "-task", "2"], spark)
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "w/out/blast").rglob("part-*")) == 5
    with pytest.raises(Exception, match="(?i)exists"):
        cli.run([*args, "-task", "0"], spark)


@pytest.mark.parametrize("more", [["-min_lis", "3", "-num_alignments", "1"], ["-id", "0.9"], ["-num_alignments", "2"], ["-task", "7"], ["-index", "5"], ["-lambda", "0.6"], ["-min_lis", "2", "-no-best"]])
def test_options_that_do_not_go_together(more):
    with pytest.raises(ValueError):
        cli.config_of(cli.parser().parse_args(["-ref", "d", "-reads", "r", *more]))


def test_strands_and_pairs():
    c = lambda *a: cli.config_of(cli.parser().parse_args(["-ref", "d", "-reads", "r", *a]))
    assert (c("-F").forward, c("-F").reverse, c("-R").forward, c("-F", "-R").reverse) == (True, False, False, True)
    assert c("-reads", "s").paired and c("-paired_in").paired and not c().paired
    assert c("-other", "-fastx").other and c("-score_split", "-threads", "4").score_split == 4


def test_help_and_version(capsys):
    cli.run(["-h"])
    cli.run(["-version"])
    assert "strandloom" in capsys.readouterr().out
