"""Relational queries over the star schema: what an event-log engine gets from Spark SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")

#: Name, and the SQL that both engines read alike.
SAME: dict[str, str] = {
    "ext_inner_join": "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000",
    "ext_left_join": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "ext_right_join": "SELECT c_custkey, o_orderkey FROM customer RIGHT JOIN orders ON c_custkey = o_custkey AND c_acctbal > 5000",
    "ext_full_join": "SELECT s.s_nationkey AS a, c.c_nationkey AS b, s.n AS n, c.m AS m FROM (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal > 3000 GROUP BY s_nationkey) s FULL OUTER JOIN (SELECT c_nationkey, count(*) AS m FROM customer WHERE c_acctbal > 9000 GROUP BY c_nationkey) c ON s.s_nationkey = c.c_nationkey",
    "ext_semi_join": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "ext_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "ext_region_pairs": "SELECT a.r_name AS a, b.r_name AS b FROM region a CROSS JOIN region b WHERE a.r_regionkey < b.r_regionkey",
    "ext_range_join": "SELECT p_partkey, band FROM part JOIN (SELECT 0 AS band, 0 AS lo, 15 AS hi UNION ALL SELECT 1, 15, 35 UNION ALL SELECT 2, 35, 100) b ON p_size >= lo AND p_size < hi",
    "ext_group": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "ext_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "ext_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "ext_grouping_sets": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())",
    "ext_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "ext_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "ext_count_distinct": "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag",
    "ext_rank": "SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)",
    "ext_ntile": "SELECT s_suppkey, CAST(ntile(4) OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS BIGINT) AS q FROM supplier",
    "ext_lag_lead": "SELECT event_id, lag(value, 1) OVER w AS a, lead(value, 2, 0e0) OVER w AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "ext_frames": "SELECT event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING) AS m, count(*) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW) AS n FROM events",
    "ext_first_last": "SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER w AS l, nth_value(event_type, 2) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "ext_percent_rank": "SELECT s_suppkey, round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey)",
    "ext_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "ext_union_all": "SELECT c_nationkey AS k, 'c' AS t FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier",
    "ext_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "ext_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "ext_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "ext_top_k_per_group": "SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn FROM lineitem) x WHERE rn <= 3",
    "ext_paging": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 100",
    "ext_strings": "SELECT p_partkey, upper(p_name) AS u, CAST(length(p_name) AS BIGINT) AS n, substring(p_name, 2, 4) AS s, replace(p_brand, '#', '-') AS b, trim(concat(' ', p_type, ' ')) AS t, lpad(CAST(p_size AS STRING), 4, '0') AS z FROM part",
    "ext_math": "SELECT l_orderkey, l_linenumber, round(sqrt(l_extendedprice), 6) AS r, abs(l_quantity - 25) AS a, CAST(floor(l_quantity / 7) AS DOUBLE) AS f, l_partkey % 17 AS m FROM lineitem",
    "ext_case": "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'low' WHEN o_totalprice < 200000 THEN 'mid' ELSE 'high' END AS band, coalesce(nullif(o_orderstatus, 'P'), '?') AS s FROM orders",
    "ext_dates": "SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS y, CAST(month(o_orderdate) AS BIGINT) AS m, CAST(day(o_orderdate) AS BIGINT) AS d FROM orders",
    "ext_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT 2 * avg(o_totalprice) FROM orders)",
    "ext_correlated_subquery": "SELECT l_orderkey, l_linenumber FROM lineitem l WHERE l_quantity > (SELECT 1.9 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey)",
    "ext_in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
    "ext_cte": "WITH big AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS t FROM orders GROUP BY o_custkey) SELECT c_name, t FROM big JOIN customer ON c_custkey = o_custkey WHERE t > 2000000",
    "ext_star": "SELECT n_name, count(*) AS n, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount), 4) AS DECIMAL(28,4))) AS DOUBLE) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    "ext_conditional_aggregate": "SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, max(CASE WHEN event_type = 'purchase' THEN event_id END) AS last_purchase FROM events GROUP BY user_id",
    "ext_turns": "SELECT conv_id, count(*) AS n, max(turn) AS last_turn, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id",
}
#: Name, the SQL for Spark and that for DuckDB.
OWN: dict[str, tuple[str, str]] = {
    "ext_array": (
        "SELECT o_custkey, array_sort(collect_list(o_orderkey)) AS ks, size(collect_set(o_orderstatus)) AS n FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS ks, CAST(count(DISTINCT o_orderstatus) AS INTEGER) AS n FROM orders GROUP BY o_custkey",
    ),
    "ext_explode": (
        "SELECT p_partkey, w FROM part LATERAL VIEW explode(split(p_name, ' ')) t AS w",
        "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part",
    ),
    "ext_map": (
        "SELECT user_id, m['click'] AS clicks, m['error'] AS errors FROM (SELECT user_id, map_from_entries(collect_list(struct(event_type, n))) AS m FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY user_id)",
        "SELECT user_id, nullif(count(*) FILTER (event_type = 'click'), 0) AS clicks, nullif(count(*) FILTER (event_type = 'error'), 0) AS errors FROM events GROUP BY user_id",
    ),
    "ext_json": (
        "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events",
        "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    ),
    "ext_regex": (
        "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS d FROM part WHERE p_type RLIKE '^[A-M]'",
        "SELECT p_partkey, regexp_extract(p_brand, '([0-9]+)', 1) AS d FROM part WHERE regexp_matches(p_type, '^[A-M]')",
    ),
    "ext_pivot": (
        "SELECT user_id, coalesce(click, 0) AS click, coalesce(view, 0) AS view FROM (SELECT user_id, event_type FROM events) PIVOT (count(*) FOR event_type IN ('click' AS click, 'view' AS view))",
        "SELECT user_id, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1",
    ),
    "ext_unpivot": (
        "SELECT l_orderkey, l_linenumber, name, v FROM lineitem UNPIVOT (v FOR name IN (l_discount, l_tax))",
        "SELECT l_orderkey, l_linenumber, 'l_discount' AS name, l_discount AS v FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem",
    ),
    "ext_time_window": (
        "SELECT unix_millis(w.start) AS at_ms, count(*) AS n FROM (SELECT window(CAST(ts AS TIMESTAMP), '30 minutes') AS w FROM events) GROUP BY w.start",
        "SELECT epoch_us(time_bucket(INTERVAL 30 MINUTE, ts)) // 1000 AS at_ms, count(*) AS n FROM events GROUP BY 1",
    ),
}


def spark_sql(text: str):
    def run(spark, sf_dir):
        frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if t in text}
        return spark.sql(_braced(text, frames), **frames)

    return run


def _braced(text: str, frames: dict) -> str:
    """Table names as references to DataFrames; aliases and column names stay."""
    import re

    names = "|".join(sorted(frames, key=len, reverse=True))
    return re.sub(rf"(?i)\b(FROM|JOIN)\s+({names})\b(?!\s*\.)(\s+(?!JOIN|ON|WHERE|GROUP|ORDER|WINDOW|LEFT|RIGHT|FULL|CROSS|LATERAL|UNION|INTERSECT|EXCEPT|UNPIVOT|PIVOT|LIMIT|HAVING)\w+)?", lambda m: f"{m[1]} {{{m[2]}}}{m[3] or ' ' + m[2]}", text)


def as_of(spark, sf_dir):
    """Each purchase with the user's last view before it: a union and a running maximum, one shuffle by user."""
    from pyspark.sql import Window as W

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").where("event_type IN ('purchase', 'view')")
    seen = F.max(F.when(F.col("event_type") == "view", F.col("event_id"))).over(W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("view_id", seen).where("event_type = 'purchase'").select("event_id", "user_id", "view_id")


REGISTERED = (
    {k: (spark_sql(q), q.replace(" AS STRING)", " AS VARCHAR)")) for k, q in SAME.items()}
    | {k: (spark_sql(q), o) for k, (q, o) in OWN.items()}
    | {"ext_as_of": (as_of, "SELECT p.event_id, p.user_id, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.event_id >= v.event_id")}
)
