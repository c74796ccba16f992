"""The commands on small files."""

import pytest

from strandloom import cli
from tests.test_genomics import GENOME, GTF


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "x.gtf").write_text("\n".join(GTF) + "\n")
    (d / "x.fa").write_text(">chr1\n" + "\n".join(GENOME[i : i + 60] for i in range(0, 330, 60)) + "\n")
    (d / "v.tsv").write_text("chr1\t26\t+\tC\tG\nchr1\t6\t+\tC\tG\n")
    (d / "s.tsv").write_text("chr1\t150\t+\nchr1\t5\t-\n")
    (d / "m.txt").write_text("ACG\t2\nACT\t1\n")
    (d / "t.tsv").write_text("gene_id\ttranscript_id\tchrom\tstrand\tspans\ng1\tt1\tchr1\t+\t11-30,51-70\n")
    (d / "p.tsv").write_text("Chrom\tPos\ng1\t3\ng1\t99\n")
    (d / "r.sam").write_text("@HD\tVN:1.6\na\t0\tt1\t3\t60\t30M\t*\t0\t0\t" + "A" * 30 + "\t" + "I" * 30 + "\n")
    (d / "q.sam").write_text("a\t0\tchr1\t13\t255\t10M\t*\t0\t0\t" + "A" * 10 + "\t" + "I" * 10 + "\tNM:i:0\n")
    (d / "g.tsv").write_text("gene_id\tgene_name\tgene_biotype\tseq\na\tRNU2-1\tsnRNA\tACGTACGT\nb\tRNU2-2P\tsnRNA\tACGTACGT\n")
    return d


def text(spark, path):
    return [r["value"] for r in spark.read.text(str(path)).collect()]


def run(spark, d, *args):
    out = d / f"out_{args[0]}_{abs(hash(args)) % 10_000}"
    assert cli.main([str(x) for x in (*args, "-o", out)], spark) == 0
    return out


def test_commands(spark, files):
    d = files
    a = text(spark, run(spark, d, "annotate", d / "v.tsv", "-r", d / "x.gtf", "--fasta", d / "x.fa", "--cache", d / "cache"))
    assert len(a) == 3 and any("Intergenic" in x for x in a) and any(GENOME[25:28] in x for x in a)
    assert any("IncompleteTranscript" in x for x in text(spark, run(spark, d, "effect", d / "v.tsv", "-r", d / "x.gtf", "--cache", d / "cache"))[1:])
    assert any("\t15" in x for x in text(spark, run(spark, d, "annot", d / "v.tsv", "--table", d / "t.tsv", "--collapse", "--count")))
    m = text(spark, run(spark, d, "motif", d / "s.tsv", "--fasta", d / "x.fa", "--pad", "10,10"))
    assert m[0].split("\t")[-1] == GENOME[139:160]
    assert len(text(spark, run(spark, d, "logo", d / "m.txt"))) == 4
    assert len(text(spark, run(spark, d, "metagene", d / "s.tsv", "-r", d / "x.gtf", "--bins", "10"))) > 3
    assert len(text(spark, run(spark, d, "metagene-point", d / "s.tsv", "-r", d / "x.gtf", "--point", "tss", "--bins", "10"))) == 11
    assert any(x.endswith("13\t+") or "\t13" in x for x in text(spark, run(spark, d, "liftover", d / "p.tsv", "-a", d / "t.tsv")))
    s = text(spark, run(spark, d, "liftover", d / "r.sam", "-a", d / "t.tsv", "--reads"))
    assert any("18M20N12M" in x for x in s) and any(x.startswith("@SQ") for x in s)
    assert any("\tt1\t3\t" in x for x in text(spark, run(spark, d, "liftover", d / "q.sam", "-a", d / "t.tsv", "--reads", "--direction", "g2t")))
    out = run(spark, d, "qc", d / "q.sam", "-r", d / "x.gtf", "--unpaired")
    assert any(x.startswith("Exonic Rate\t1") for x in text(spark, out / "metrics.tsv"))
    assert text(spark, run(spark, d, "coordinate", d / "s.tsv", "--style", "U2E"))[0].startswith("1\t")
    assert any("gene_id" in x for x in text(spark, run(spark, d, "refine", d / "x.gtf")))
    assert any("11-30,51-70" in x for x in text(spark, run(spark, d, "prepare", d / "x.gtf")))
    assert sum("U2" in x for x in text(spark, run(spark, d, "group", d / "g.tsv"))) == 2
    ref = run(spark, d, "reference-build", d / "x.gtf")
    assert len(text(spark, run(spark, d, "reference-export", ref))) == 4 and any("stop_codon" in x for x in text(spark, run(spark, d, "reference-export", ref, "--gtf")))


def test_errors(spark, files, capsys):
    assert cli.main([str(x) for x in ("motif", files / "v.tsv", "--fasta", files / "x.fa", "--columns", "1,4,3", "-o", files / "bad")], spark) == 1
    assert "error" in capsys.readouterr().err
