"""Readers, writers, expressions and streaming on small files."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from spanforge.functions import exprs
from spanforge.sources import readers, sinks
from spanforge.streaming import progress


def write(path, text, gz=False):
    (gzip.open if gz else open)(path, "wt").write(text)
    return str(path)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_regions_and_spaces(spark, tmp_path):
    p = write(tmp_path / "r.tsv.gz", "gene_id\tchrom\tstart0\tend0\teffect\nG1\tchr1\t10\t20\t0.5\nG1\tchr1\t10\t20\t0.6\nG2\t1\t5\t9\t\n", True)
    r = readers.regions(spark, p)
    assert r.count() == 2 and {x.length for x in r.collect()} == {10, 4} and dict(r.dtypes)["chrom"] == "string"
    b = write(tmp_path / "t.bed", "#c\ntrack x\nchr1\t0\t9\tG1\n\nchr1\tx\t9\tG1\n")
    assert rows(readers.bed(spark, b)) == [("chr1", 0, 9)]
    with pytest.raises(ValueError):
        readers.tested_space(spark, write(tmp_path / "e.bed", "#\n"))
    with pytest.raises(ValueError):
        readers.regions(spark, write(tmp_path / "bad.tsv", "gene_id\tchrom\nG\tc\n"))


def test_bedgraph_in_territory(spark, tmp_path):
    p = write(tmp_path / "s.bedgraph", "chr1\t0\t10\t1.5\nchr1\t10\t20\t0.1\nchr2\t0\t5\t9\n")
    land = spark.createDataFrame([("chr1", 5, 12)], "chrom string, start0 bigint, end0 bigint")
    assert rows(readers.bedgraph(spark, p, land, 1.0)) == [("chr1", 5, 10, 1.5)]


def test_anchors(spark, tmp_path):
    p = write(tmp_path / "a.bed", "chr1\t5\t6\tG1.2\t0\t+\nchr1\t9\t11\tG2\t0\t+\nchr1\t1\t2\tG3\t0\t*\nchr2\t1\t2\tG4\t0\t-\nchr2\t3\t4\tG4\t0\t-\nchr2\t7\n")
    good, bad = readers.strict_anchors(spark, p)
    assert rows(good) == [("G1.2", "chr1", 5, "+")]
    assert sorted(r.reason for r in bad.collect()) == ["ambiguous_tss", "fields", "not_one_base", "strand"]
    targets = spark.createDataFrame([("G1.7",), ("G9",)], "gene_id string")
    found, skipped = readers.match_anchors(targets, good)
    assert rows(found) == [("G1.7", "chr1", 5, "+")] and rows(skipped) == [("G9", "missing_tss")]


def test_gtf(spark, tmp_path):
    p = write(tmp_path / "g.gtf", '#x\nchr1\ts\ttranscript\t11\t20\t.\t-\t.\tgene_id "G1"; transcript_id "T1"; tag "basic";\nchr1\ts\ttranscript\t5\t30\t.\t-\t.\tgene_id "G1"; transcript_id "T2"; tag "basic"; tag "MANE_Select";\nchrM\ts\ttranscript\t5\t30\t.\t-\t.\tgene_id "G2"; transcript_id "T3";\nchr1\ts\texon\t10\t12\t.\t-\t.\tgene_id "G1";\nchr1\ts\texon\t13\t15\t.\t-\t.\tgene_id "G1";\nchr1\ts\texon\t20\t21\t.\t-\t.\tgene_id "G1";\n')
    best = readers.canonical_transcripts(readers.gtf(spark, p, "transcript")).collect()
    assert [(r.gene_id, r.transcript_id, r.tss0) for r in best] == [("G1", "T2", 29)]
    p = write(tmp_path / "h.gtf", "".join(f'chr1\ts\ttranscript\t{s}\t90\t.\t+\t.\tgene_id "{g}"; transcript_id "{t}"; tag "{tag}";\n' for g, s, t, tag in [("G1.4", 30, "T9", "Ensembl_canonical"), ("G1.4", 20, "T1", "Ensembl_canonical"), ("G2.1", 5, "T2", "basic"), ("G3.1", 7, "T3", "Ensembl_canonical"), ("G3.1", 8, "T4", "MANE_Select"), ("G4_PAR_Y", 8, "T5", "MANE_Select")]))
    best = readers.canonical_transcripts(readers.gtf(spark, p, "transcript")).collect()
    assert sorted((r.gene_id, r.transcript_id, r.tss0) for r in best) == [("G1", "T9", 29), ("G3", "T4", 7)]  # the first in the file; no tag, no gene
    p = str(tmp_path / "g.gtf")
    assert rows(readers.exon_unions(readers.gtf(spark, p, "exon")).select("start0", "end0")) == [(19, 21), (9, 15)]


def test_fasta(spark, tmp_path):
    seq = "ACGT" * 500 + "AT"
    p = write(tmp_path / "g.fa", ">chr1 x\n" + "\n".join(seq[i : i + 61] for i in range(0, len(seq), 61)) + "\n>chr2\nGG\n")
    spans = [("chr1", 0, 4), ("chr1", 58, 70), ("chr1", -3, 5), ("chr1", 1998, 2006), ("chr2", 0, 2), ("chrX", 3, 5), ("chr1", 10, 700)]
    got = readers.fetch(spark.createDataFrame(spans, "chrom string, start0 bigint, end0 bigint"), readers.fasta(spark, p, 64), 64).collect()
    base = {"chr1": seq, "chr2": "GG"}
    for r in got:
        s = base.get(r.chrom, "")
        assert r.sequence == "".join(s[i] if 0 <= i < len(s) else "N" for i in range(r.start0, r.end0)), r


def test_lists_and_results(spark, tmp_path):
    p = write(tmp_path / "l.txt", "#c\ngene_id\tx\nENSG1\t1\nENSG2\t2\nENSG1\t3\n")
    assert {r.gene_id for r in readers.gene_list(spark, p, pattern="^ENSG[0-9]+$").collect()} == {"ENSG1", "ENSG2"}
    m = write(tmp_path / "m.txt", "Motif Name\tConsensus\tP-value\tLog P-value\tq-value (Benjamini)\t# of Target Sequences with Motif(of 90)\t% of Target Sequences with Motif\t# of Background Sequences with Motif(of 900)\t% of Background Sequences with Motif\nCTCF(Zf)/x\tAC\t1e-9\t-20.7\t0.01\t9\t10.00%\t9\t1.00%\n")
    r = readers.motif_results(spark, m).collect()[0]
    assert (r.motif, r.log_p, r.pct_target, r.pct_background, r.n_target, r.n_background) == ("CTCF(Zf)/x", -20.7, 10.0, 1.0, 90, 900)
    t = write(tmp_path / "tracks.tsv", "name path type role\nA a.bw bigwig call\nA a.bed bed call\nB b.bed  bed call\nM m.bed bed mask\n")
    assert rows(readers.annotation_sets(readers.manifest(spark, t))) == [("A", ["a.bw"]), ("B", ["b.bed"])]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("chr1", 0, 5, "a", 0.123456789012, True), ("chr1", 5, 9, "b", None, False)], "chrom string, start0 bigint, end0 bigint, name string, v double, hit boolean")
    sinks.tsv(df, f"{tmp_path}/t", gz=True, null="NA")
    back = readers.table(spark, f"{tmp_path}/t", null="NA")
    assert rows(back.select("name", "v", "hit")) == [("a", "0.123456789012", "1"), ("b", None, "0")]
    sinks.bedgraph(df, f"{tmp_path}/g", "v")
    assert rows(readers.bedgraph(spark, f"{tmp_path}/g")) == [("chr1", 0, 5, 0.123456789)]
    sinks.bed6(df, f"{tmp_path}/b", "name")
    assert rows(spark.read.text(f"{tmp_path}/b")) == [("chr1\t0\t5\ta\t0\t.",), ("chr1\t5\t9\tb\t0\t.",)]
    sinks.by_class(df, f"{tmp_path}/c", "name")
    assert spark.read.parquet(f"{tmp_path}/c").where("name = 'a'").count() == 1


def test_expressions(spark):
    df = spark.createDataFrame([("chr1", "G.1.2", 5.0), ("X", "G", 0.0), ("chrUn_1", "a/b", None)], "chrom string, gene string, v double")
    got = df.select(
        exprs.toggled_chrom("chrom"), exprs.primary_contig("chrom"), exprs.without_version("gene"), exprs.without_version("gene", True), exprs.safe_file_name("gene"), exprs.cut("v", [0, 5, 10], ["a", "b"]), exprs.cut("v", [0, 5, 10], ["a", "b"], True), exprs.is_main_chrom("chrom"), exprs.n_present("chrom", "v")
    ).collect()
    assert tuple(got[0]) == ("1", "1", "G", "G.1", "G.1.2", "b", "a", True, 2)
    assert tuple(got[1]) == ("chrX", "X", "G", "G", "G", "a", "a", True, 2)
    assert got[2][1] is None and got[2][4].startswith("a_b-") and got[2][5] is None and got[2][8] == 1
    pairs = spark.createDataFrame([("CTCF(Zf)", "ctcf"), ("SP", "SP1"), ("KLF4", "GATA")], "a string, b string").select(exprs.alias_match("a", "b")).collect()
    assert [r[0] for r in pairs] == [True, False, False]


def test_resume(spark, tmp_path):
    plan = spark.range(10).withColumnRenamed("id", "window_id")
    seen = []

    def work(df):
        seen.append(df.count())
        return df.withColumn("v", F.col("window_id") * 2)

    path = f"{tmp_path}/done"
    progress.resume(plan.where("window_id < 4"), path, ["window_id"], work, "f1")
    out = progress.resume(plan, path, ["window_id"], work, "f1")
    assert seen == [4, 6] and out.count() == 10
    with pytest.raises(ValueError):
        progress.resume(plan, path, ["window_id"], work, "f2")


def test_rolling_stream(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src)
    want = rows(progress.rolling(events, ["event_type"], "1 day").select("start", "event_type", "n"))
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = progress.rolling(stream, ["event_type"], "1 day").writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("rolled").select("start", "event_type", "n")) == want


def test_many_small_files_keep_their_order_and_lose_their_headers(spark, tmp_path):
    for i in range(5):
        write(tmp_path / f"part{i}.txt", "name path role\n" + "".join(f"n{i}_{j} p call\n" for j in range(4)))
    got = readers.placed_lines(spark, f"{tmp_path}/part*.txt").orderBy("position").collect()
    assert [r.value for r in got] == [v for i in range(5) for v in ("name path role", *(f"n{i}_{j} p call" for j in range(4)))]
    assert {r.name for r in readers.manifest(spark, f"{tmp_path}/part*.txt").collect()} == {f"n{i}_{j}" for i in range(5) for j in range(4)}
    write(tmp_path / "part9.txt", "other header\nx y\n")
    with pytest.raises(ValueError, match="different headers"):
        readers.manifest(spark, f"{tmp_path}/part*.txt")
