"""Sets with a passage in common that fills most of each, but less than the similarity: they meet by their sizes, and none that may be linked is lost."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from spanforge.llm import near_dedup


def rows_of_joins(spark, run) -> int:
    """The most rows that one join makes while ``run`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    seen = store.executionsList().size()
    run()
    most = 0
    for i in range(seen, store.executionsList().size()):
        number = store.executionsList().apply(i).executionId()
        values, nodes = store.executionMetrics(number), store.planGraph(number).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for metric in (node.metrics().apply(j) for j in range(node.metrics().size())) if "Join" in node.name() else ():
                if metric.name() == "number of output rows" and values.contains(metric.accumulatorId()):
                    most = max(most, int(values.apply(metric.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize(("size", "own", "common"), [(2, range(87, 97, 2), range(2, 20, 4)), (5, (90, 96), (2, 10))], ids=["op7", "pipeline"])
def test_a_common_passage_makes_no_pairs(spark, size, own, common):
    passage = [f"p{i}" for i in range(86)]
    texts = [passage + [f"o{i}x{j}" for j in range(15)] for i in range(300)]
    for i in range(0, 300, 10):  # chains of two links: the ends are no pair
        middle = [f"{w}y" if j in own else w for j, w in enumerate(texts[i])]
        texts += [middle, [f"{w}z{i}" if j in common else w for j, w in enumerate(middle)]]
    random.Random(8).shuffle(texts)
    sets = [near_dedup.shingles(" ".join(t).encode(), size) for t in texts]
    want = list(range(len(texts)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if 100 * len(x & y) >= 80 * len(x | y):
                want = [min(want[i], want[j]) if g in (want[i], want[j]) else g for g in want]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string").repartition(4)
    got = {}
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # plans that found no row would be listed without their joins
    try:
        most = rows_of_joins(spark, lambda: got.update({r.doc_id: r.component_id for r in near_dedup.link(docs, size=size).collect()}))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) == 300
    assert 0 < most < 100_000  # 64,620 pairs of texts, which have five or six shingles of their rarest fifth in common; 100 shingles of each text are rows too


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_sets_that_may_be_linked_meet_in_a_bucket(spark, percent):
    sizes = [*range(1, 70), 499, 500, 501, 624, 625, 626]
    rows = [(m, m, m, at, 7) for m in sizes for at in range(m)]
    docs = spark.createDataFrame(rows, "class bigint, label bigint, m int, at int, token bigint")
    keys: dict[tuple[int, int], set] = {}
    for r in near_dedup._by_sizes(docs, percent).groupBy("m", "at").agg(F.collect_list(F.struct("lo", "hi", "side")).alias("k")).collect():
        keys[r.m, r["at"]] = {tuple(k) for k in r.k}
    for x in sizes:
        for y in sizes:
            need = -(-percent * (x + y) // (100 + percent))
            if need <= min(x, y):  # at the last places from which both have enough shingles left
                mine, others = keys[x, x - need], keys[y, y - need]
                assert any((lo, hi, side if lo == hi else 1 - side) in others for lo, hi, side in mine), (x, y)
