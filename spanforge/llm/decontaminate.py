"""Benchmark decontamination: a prefix-filtered set join with exact verification.

An item's windows are its runs of ``WINDOW`` words (one window, the whole item, where it has fewer). A document that
contains a window holds all its words, so joining on one of them finds every occurrence: the window's words are ordered by rarity in the documents, and the
rarest is its prefix token. Where a document's word is a prefix token, the token's offset in the window tells where the window would begin; beginnings
before the text's start or ends beyond its last word are left out (positional and length bounds), and the words from there are compared with the
window exactly.

Everything is DataFrame functions. The prefix table (token -> windows) is broadcast only if it is counted to have at most ``SMALL`` windows; beyond that the
documents' tokens are shuffled to it. Tokens are looked up one row for each word, and only rows that match go on; matches are
gathered for each document, whose number is bounded by its own words.

Words: A-Z lower-cased, runs of ASCII letters, digits and bytes beyond ASCII. Null or empty texts have no words; an item without words has no
windows; items with a null id don't count. Equal (doc_id, text) rows give equal rows of results. Other columns pass through untouched where
they don't begin with ``_dc_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spanforge.llm.common import cut, table

WINDOW, SMALL = 10, 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The array of a text's words; empty for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Each distinct window (_dc_win) with its length and the ids of the items that hold it."""
    w = F.col("_dc_words")
    n = F.size(w)
    cuts = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - size + 1)), lambda i: F.slice(w, i, size))
    return (
        benchmark.where(F.col("item_id").isNotNull())
        .select("item_id", words(F.col("text")).alias("_dc_words"))
        .where(n > 0)
        .select("item_id", F.explode(cuts).alias("_dc_win"))
        .groupBy("_dc_win")
        .agg(F.sort_array(F.collect_set("item_id")).alias("_dc_items"))
    )


def prefixes(docs: DataFrame, wins: DataFrame) -> tuple[DataFrame, int]:
    """The prefix table: _dc_token, and its windows as structs (win, offset, items); and its number of windows."""
    wins = cut(wins, "windows")
    vocabulary = wins.select(F.explode("_dc_win").alias("_dc_token")).distinct()
    n = wins.count()
    if n <= SMALL:
        vocabulary = F.broadcast(vocabulary)
    seen = docs.select(F.explode(words(F.col("text"))).alias("_dc_token")).join(vocabulary, "_dc_token", "left_semi").groupBy("_dc_token").agg(F.count("*").alias("_dc_freq"))
    # tokens that no document holds are the rarest, and their windows occur nowhere
    ranked = wins.select("_dc_win", "_dc_items", F.posexplode("_dc_win").alias("_dc_off", "_dc_token")).join(seen, "_dc_token", "left")
    best = ranked.groupBy("_dc_win", "_dc_items").agg(F.min(F.struct(F.coalesce("_dc_freq", F.lit(0)).alias("f"), F.col("_dc_token").alias("t"), F.col("_dc_off").alias("o"))).alias("_dc_best")).where("_dc_best.f > 0")
    found = best.groupBy(F.col("_dc_best.t").alias("_dc_token")).agg(F.collect_list(F.struct(F.col("_dc_win").alias("win"), F.col("_dc_best.o").alias("off"), F.col("_dc_items").alias("items"))).alias("_dc_wins"))
    return cut(found, "prefixes"), n


def matches(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, _dc_key, _dc_hits): for each document with occurrences, their structs (begin, len, items), sorted by begin."""
    table_, n = prefixes(docs, windows(benchmark, size))
    texts = docs.select("doc_id", F.xxhash64("text").alias("_dc_key"), words(F.col("text")).alias("_dc_words"))
    # of the document only the words around a match go on: a window reaches at most ``size`` - 1 words to either side
    near = F.slice("_dc_words", F.greatest(F.col("_dc_at") - (size - 2), F.lit(1)), 2 * size - 1).alias("_dc_near")
    if n <= SMALL:
        around = texts.select("*", F.posexplode("_dc_words").alias("_dc_at", "_dc_token")).join(F.broadcast(table_), "_dc_token")
    else:  # the words are shuffled alone and the matching positions go back to their texts
        spots = texts.select("doc_id", "_dc_key", F.posexplode("_dc_words").alias("_dc_at", "_dc_token")).join(table_, "_dc_token").distinct()
        around = spots.alias("s").join(texts.alias("t"), F.expr("s.doc_id <=> t.doc_id AND s._dc_key = t._dc_key")).select("t.*", "_dc_at", "_dc_wins")
    around = around.select("doc_id", "_dc_key", "_dc_at", "_dc_wins", F.size("_dc_words").alias("_dc_size"), near)
    begin = lambda w: F.col("_dc_at") - w["off"]
    inner = lambda w: begin(w) - F.greatest(F.col("_dc_at") - (size - 1), F.lit(0)) + 1
    # _dc_near stands twice below: so Spark computes it beside the join, inside generated code, and the document's array of words goes no further.
    # Nothing is filtered before the aggregation, as a filter would move into the join and bring the array there
    fits = F.filter(
        "_dc_wins",
        lambda w: (begin(w) >= 0) & (begin(w) + F.size(w["win"]) <= F.col("_dc_size")) & (inner(w) + F.size(w["win"]) - 1 <= F.size("_dc_near")) & (F.slice("_dc_near", F.greatest(inner(w), F.lit(1)), F.size(w["win"])) == w["win"]),
    )
    hits = around.select("doc_id", "_dc_key", F.transform(fits, lambda w: F.struct(begin(w).alias("begin"), F.size(w["win"]).alias("len"), w["items"].alias("items"))).alias("_dc_found"))
    return hits.groupBy("doc_id", "_dc_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_dc_found")))).alias("_dc_hits")).where(F.size("_dc_hits") > 0)


def report(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, items (sorted strings), n_items, items_sha256, contaminated, _dc_key."""
    hits = matches(docs, benchmark, size)
    covered = F.aggregate(
        "_dc_hits",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda s, h: F.struct((s["n"] + F.greatest(F.lit(0), h["begin"] + h["len"] - F.greatest(s["upto"], h["begin"]))).alias("n"), F.greatest(s["upto"], h["begin"] + h["len"]).alias("upto")),
    )["n"]
    items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("_dc_hits", lambda h: h["items"]))), lambda i: i.cast("string")))
    found = hits.select("doc_id", "_dc_key", covered.cast("long").alias("_dc_n"), items.alias("_dc_items"))
    left = docs.select("doc_id", F.xxhash64("text").alias("_dc_key"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    n_hit = F.coalesce("_dc_n", F.lit(0)).cast("long")
    names = F.coalesce("_dc_items", F.array().cast("array<string>"))
    both = left.alias("l").join(found.alias("r"), F.expr("l.doc_id <=> r.doc_id AND l._dc_key = r._dc_key"), "left")
    return both.select("l.doc_id", "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.col("l._dc_key"))


QUERIES = {"op1_prefix_decontaminate": lambda spark, sf_dir: report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_dc_key")}

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
ORACLE = {
    "op1_prefix_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, w[i:i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM wins),
spots AS (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, item_id, i, n FROM spots JOIN wins USING (win)),
pos AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)"""
}
