"""Guards, masks, matched nulls and readers that don't depend on splits."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from spanforge.operators import intervals as I, knockouts, reports, sampling, stats
from spanforge.plans import chain
from spanforge.plans.signal_queries import matched_null_regions
from spanforge.plans.views import view
from spanforge.sources import readers
from spanforge.sources.shared import clear, mark, shared_dir, written

SF = "/root/testdata/sf0.001"


def test_matched_nulls_keep_their_promises(spark):
    found = matched_null_regions(spark, SF).collect()
    hits = {r.region_id: r for r in reports.top_rows(view(spark, SF, "regions").select("region_id", "gene_id", "chrom", "start0", "end0", "effect"), ["gene_id"], "effect", 3).collect()}
    assert len(found) > 60 and len({(r.hit_id, r.rep) for r in found}) == len(found)
    space = [(t.gene_id, t.start0, t.end0) for t in view(spark, SF, "tested").collect()]
    blocks = [(b.chrom, b.start0, b.end0) for b in I.merge(view(spark, SF, "tracks").where("track = 'A'"), ("chrom",)).collect()]
    share = lambda r: sum(max(0, min(r.end0, e) - max(r.start0, s)) for c, s, e in blocks if c == r.chrom) / (r.end0 - r.start0)
    for i, r in enumerate(found):
        hit = hits[r.hit_id]
        assert r.end0 - r.start0 == hit.end0 - hit.start0 and any(g == r.gene_id and s <= r.start0 and r.end0 <= e for g, s, e in space)
        assert abs(share(r) - share(hit)) <= 0.05 + 1e-9
        others = [*hits.values(), *found[:i]]
        assert not any(o.gene_id == r.gene_id and o.chrom == r.chrom and o.start0 < r.end0 and r.start0 < o.end0 for o in others)


@pytest.mark.parametrize("split", ["64", "1000", "134217728"])
def test_files_may_be_split_anywhere(spark, tmp_path, split):
    bases = {f"c{i}": "ACGTN"[i % 5] * 7 + "GATTACA" * (40 * i) + "T" * (i % 3) for i in range(1, 5)}
    text = "".join(f">{n} note\r\n" + "".join(f"{s[a : a + 50]}\r\n" for a in range(0, len(s), 50)) for n, s in bases.items())
    (tmp_path / "x.fa").write_text(text, newline="")
    (tmp_path / "list.txt").write_text("# note\nname\tgene_id\n" + "".join(f"n{i}\tg{i % 50}\n" for i in range(100)))
    (tmp_path / "tracks.txt").write_text("name  path role\n" + "".join(f"t{i} /p/{i}\n" for i in range(60)) + "name path role\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        chunks = readers.fasta(spark, f"{tmp_path}/x.fa", 64).collect()
        ids = [r.gene_id for r in sorted(readers.gene_list(spark, f"{tmp_path}/list.txt").collect(), key=lambda r: r.position)]
        rows = readers.manifest(spark, f"{tmp_path}/tracks.txt").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = Counter()
    for n in bases:
        mine = sorted((r.chunk, r.sequence) for r in chunks if r.contig == n)
        assert "".join(s for _, s in mine) == bases[n] and [c for c, _ in mine] == list(range(len(mine)))
        got[n] += 1
    assert ids == [f"g{i}" for i in range(50)]
    assert len(rows) == 61 and rows[0].asDict().keys() == {"name", "path", "role"} and sum(r.name == "name" for r in rows) == 1


def test_masks_scramble_their_intervals_only(spark):
    text = "ACGTTGCA" * 20
    rows = [(1, text, 100, [(90, 120), (115, 130), (200, 300)]), (2, text, 0, []), (3, None, 0, [(1, 2)])]
    kind = "id int, sequence string, start0 int, spans array<struct<start0:int,end0:int>>"
    got = {r.id: r for r in sampling.masked_sequences(spark.createDataFrame(rows, kind), "sequence", "start0", "spans", 5).collect()}
    new = got[1].masked
    assert got[1].masked_bp == 30 + 60 and new[30:100] == text[30:100] and new[:30] != text[:30] and Counter(new[:30]) == Counter(text[:30])
    assert got[2].masked == text and got[2].masked_bp == 0 and got[3].masked is None
    reps = spark.createDataFrame([(i, text, 0, [(0, 60)], g, k) for i, (g, k) in enumerate([("a", 0), ("a", 1), ("b", 0), ("a", 0)])], kind + ", gene string, rep int")
    drawn = {r.id: r.masked for r in sampling.masked_sequences(reps, "sequence", "start0", "spans", 5, name="gene", rep="rep").collect()}
    assert drawn[0] == drawn[3] and len({drawn[0], drawn[1], drawn[2]}) == 3
    for bad in ("AAAAAAAA", "ACGNACGT", "ACGRACGT"):
        with pytest.raises(Exception, match="scrambling changes nothing|letters other than"):
            sampling.masked_sequences(spark.createDataFrame([(1, bad, 0, [(0, 8)])], kind), "sequence", "start0", "spans", 5).collect()


def test_guards(spark):
    df = spark.createDataFrame([("a", 1, True), ("b", 2, False)], "key string, Value int, done boolean")
    with pytest.raises(ValueError, match="exist already"):
        reports.add_columns(df, {"value": F.lit(1)})
    with pytest.raises(ValueError, match="1 rows"):
        reports.require_complete(df, "done")
    with pytest.raises(ValueError, match="differ"):
        reports.one_contract(df, "key", ["Value"])
    with pytest.raises(ValueError, match="unchanged"):
        knockouts.require_noop(df, "Value")
    with pytest.raises(ValueError, match="differ"):
        knockouts.require_reproduced(df, df.withColumn("Value", F.col("Value") + 1), ["key"], "Value")
    assert knockouts.require_reproduced(df, df, ["key"], "Value") is df
    assert reports.clean_names(df.toDF("A b", "a_b", "%")).columns == ["a_b", "a_b_2", "x"]
    assert [r.stratum for r in reports.strata_order(spark.createDataFrame([("b",), ("all",), ("a",)], "stratum string")).collect()] == ["all", "a", "b"]
    assert [r.key for r in reports.by_row_max(df, ["Value"]).collect()] == ["b", "a"]
    with pytest.raises(ValueError, match="permutations"):
        chain.run(spark, SF, chain.EngineConfig(perms=0))


def test_tables_are_cleared(spark):
    since = mark(spark)
    one, two = written(spark.range(3), "one"), written(spark.range(4), "two")
    clear(spark, since, keep=1)
    assert two.count() == 4 and mark(spark) == since + 1 and shared_dir(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        one.count()
    clear(spark, since)


def test_ntile_is_the_window_function(spark):
    for n in (1, 3, 4, 7, 30):
        rows = stats.ranked(spark.range(n).withColumn("k", F.lit(1)).withColumn("v", F.col("id") * 37 % 11), ["k"], "v", ["id"], 3)
        got = rows.withColumn("got", stats.ntile("_row", "_all", 4)).withColumn("want", F.expr("ntile(4) OVER (PARTITION BY k ORDER BY v, id)"))
        assert got.where("got <> want").isEmpty() and got.count() == n
