"""The driver's tables seen as interval relations.

Each view is one SELECT in a dialect that ``spark_sql`` and ``duck_sql`` spell for either engine: {S} is the string type, {SEC}
seconds since the first event, {DAY} days since the first shipping date, {BASES} a supplier's items as a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_SPARK = {"{S}": "STRING", "{SEC}": "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)", "{DAY}": "datediff(CAST(l_shipdate AS DATE), DATE'1995-01-01')",
    "{BASES}": "array_join(transform(array_sort(collect_list(struct(l_orderkey, l_linenumber, substr('ACGT', CAST(l_partkey % 4 AS INT) + 1, 1) AS b))), x -> x.b), '')"}
_DUCK = {"{S}": "VARCHAR", "{SEC}": "date_diff('second', TIMESTAMP '2024-01-01 00:00:00', ts)", "{DAY}": "date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE))",
    "{BASES}": "string_agg(substr('ACGT', CAST(l_partkey % 4 AS INTEGER) + 1, 1), '' ORDER BY l_orderkey, l_linenumber, l_partkey % 4)"}

VIEWS = {
    "all_regions": """SELECT concat('g', CAST(user_id AS {S})) AS gene_id, concat('chr', CAST(user_id % 5 + 1 AS {S})) AS chrom, CAST({SEC} AS BIGINT) AS start0,
  CAST({SEC} AS BIGINT) + 500 + 150 * CAST(floor(value) AS BIGINT) AS end0, CASE event_id % 3 WHEN 0 THEN 'increase' WHEN 1 THEN 'decrease' ELSE 'mixed' END AS direction,
  event_type AS annotation, CAST(floor(value * 100) AS BIGINT) AS effect, event_id FROM events""",
    "regions": """SELECT region_id, gene_id, chrom, start0, end0, end0 - start0 AS length, direction, annotation, effect, event_id FROM
  (SELECT *, concat_ws('|', gene_id, chrom, CAST(start0 AS {S}), CAST(end0 AS {S})) AS region_id, row_number() OVER (PARTITION BY gene_id, chrom, start0, end0 ORDER BY event_id) AS rn FROM all_regions) AS t WHERE rn = 1""",
    "extent": "SELECT gene_id, chrom, min(start0) AS lo, max(end0) AS hi FROM regions GROUP BY gene_id, chrom",
    "tested": """SELECT gene_id, chrom, CASE WHEN short THEN lo ELSE lo + i * third + CASE WHEN i > 0 THEN 10000 ELSE 0 END END AS start0, CASE WHEN short THEN lo + 30000 ELSE lo + (i + 1) * third - CASE WHEN i < 2 THEN 10000 ELSE 0 END END AS end0
  FROM (SELECT gene_id, chrom, lo, CAST(floor((hi - lo) / 3) AS BIGINT) AS third, substr(gene_id, length(gene_id)) = '0' AS short FROM extent) AS e CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 AS i UNION ALL SELECT 2 AS i) AS n
  WHERE CASE WHEN short THEN i = 0 ELSE third > 20000 END""",
    "tracks": """SELECT l_returnflag AS track, concat(l_returnflag, '_', l_linestatus) AS file, concat('chr', CAST(l_suppkey % 5 + 1 AS {S})) AS chrom, CAST({DAY} AS BIGINT) * 1000 + l_linenumber * 100 AS start0,
  CAST({DAY} AS BIGINT) * 1000 + l_linenumber * 100 + 100 + CAST(floor(l_quantity) AS BIGINT) * 10 AS end0, CAST(floor(l_quantity) AS BIGINT) AS value FROM lineitem""",
    "tss": "SELECT gene_id, chrom, (CAST(substr(gene_id, 2) AS BIGINT) * 7919) % 2592000 AS tss0, CASE WHEN CAST(substr(gene_id, 2) AS BIGINT) % 2 = 0 THEN '+' ELSE '-' END AS strand FROM extent",
    "windows": """SELECT gene_id, chrom, b * 50000 AS start0, b * 50000 + 100000 AS end0, CASE WHEN n > 1 OR s % 3 > 0 THEN CAST(s AS DOUBLE) / n - 15000 END AS value, CASE WHEN n > 1 OR s % 3 > 0 THEN CAST(a AS DOUBLE) / n END AS size FROM
  (SELECT gene_id, chrom, CAST(floor(start0 / 50000) AS BIGINT) AS b, sum(effect) AS s, sum(abs(effect - 15000)) AS a, count(*) AS n FROM regions GROUP BY gene_id, chrom, CAST(floor(start0 / 50000) AS BIGINT)) AS t""",
    "scores": """SELECT gene_id, CAST(floor(start0 / 100000) AS BIGINT) AS window_id, event_id % 5 AS rep, CAST(min(effect) - 9000 AS DOUBLE) / 1000 AS delta, CAST(max(effect) AS DOUBLE) / 1000 AS masked, min(length) AS changed_bp
  FROM regions GROUP BY gene_id, CAST(floor(start0 / 100000) AS BIGINT), event_id % 5""",
    "genome": "SELECT concat('s', CAST(l_suppkey AS {S})) AS gene_id, concat('chr', CAST(l_suppkey % 5 + 1 AS {S})) AS chrom, CAST(l_suppkey AS BIGINT) * 1000 AS start0, {BASES} AS sequence FROM lineitem GROUP BY l_suppkey",
    "canon": "SELECT DISTINCT track, chrom, start0, end0 FROM tracks",
}
NEEDS = {"regions": ["all_regions"], "extent": ["regions"], "tested": ["extent"], "tss": ["extent"], "windows": ["regions"], "scores": ["regions"], "canon": ["tracks"]}
TABLES = {"all_regions": "events", "tracks": "lineitem", "genome": "lineitem"}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in [*_closure(tuple(NEEDS.get(n, []))), n]:
            if x not in out:
                out.append(x)
    return out


def _spell(sql: str, words: dict[str, str]) -> str:
    for k, v in words.items():
        sql = sql.replace(k, v)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view as a DataFrame."""
    names = _closure((name,))
    tables = {TABLES[n] for n in names if n in TABLES}
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    sql = "WITH " + ", ".join(f"{n} AS ({_spell(_bind(VIEWS[n], tables), _SPARK)})" for n in names) + f" SELECT * FROM {name}"
    return spark.sql(sql, **{f"t_{t}": f for t, f in frames.items()})


def _bind(sql: str, tables: set[str]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{t_{t}}}")
    return sql


def oracle(sql: str, *names: str) -> str:
    """DuckDB SQL: the views it needs, then ``sql``, which may begin with more named queries (``x AS (...), ... SELECT``)."""
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({_spell(VIEWS[n], _DUCK)})" for n in _closure(names)) + (", " if not sql.lstrip().upper().startswith("SELECT") else " ") + sql
