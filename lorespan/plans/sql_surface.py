"""The SQL passthrough: one text for both engines wherever their dialects agree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespan import sql
from lorespan.adapters import Tables
from lorespan.operators import documents, windows
from lorespan.plans.registry import ENTRIES, query

#: Key: (Spark SQL, DuckDB SQL or None where the same text runs on both).
_SUITE = {
    "sql_joins_suite": (
        """SELECT 'left' AS kind, count(*) AS n, count(o.o_orderkey) AS m FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000
        UNION ALL SELECT 'full', count(*), count(l.doc_id) FROM documents d FULL OUTER JOIN labels l ON l.doc_id = d.doc_id AND l.quality = 1
        UNION ALL SELECT 'right', count(*), count(c.c_custkey) FROM orders o RIGHT JOIN customer c ON o.o_custkey = c.c_custkey AND o.o_totalprice > 300000
        UNION ALL SELECT 'natural', count(*), max(r_regionkey) FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) x NATURAL JOIN region
        UNION ALL SELECT 'cross', count(*), count(DISTINCT r_name) FROM region CROSS JOIN nation
        UNION ALL SELECT 'theta', count(*), max(a.n_nationkey) FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey
        UNION ALL SELECT 'using', count(*), count(DISTINCT doc_id) FROM documents JOIN labels USING (doc_id)
        UNION ALL SELECT 'exists', count(*), 0 FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 49)
        UNION ALL SELECT 'not exists', count(*), 0 FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)
        UNION ALL SELECT 'in', count(*), 0 FROM part WHERE p_brand IN (SELECT p_brand FROM part WHERE p_size = 50) OR p_size BETWEEN 3 AND 5
        UNION ALL SELECT 'null safe', count(*), 0 FROM documents d JOIN labels l ON l.doc_id IS NOT DISTINCT FROM d.doc_id""",
        None,
    ),
    "sql_sets_suite": (
        """SELECT 'union' AS op, count(*) AS n FROM (SELECT lang FROM documents UNION SELECT event_type FROM events) a
        UNION ALL SELECT 'union all', count(*) FROM (SELECT lang FROM documents UNION ALL SELECT event_type FROM events) b
        UNION ALL SELECT 'intersect', count(*) FROM (SELECT p_size FROM part INTERSECT SELECT CAST(l_quantity AS INT) FROM lineitem) c
        UNION ALL SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) d
        UNION ALL SELECT 'intersect all', count(*) FROM (SELECT p_size FROM part INTERSECT ALL SELECT n_nationkey FROM nation) e
        UNION ALL SELECT 'except all', count(*) FROM (SELECT n_regionkey FROM nation EXCEPT ALL SELECT r_regionkey FROM region) f""",
        None,
    ),
    "sql_windows_suite": (
        """SELECT c_custkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS rk, dense_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey) AS dr, ntile(4) OVER w AS quarter,
        round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey), 6) AS pr, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey), 6) AS cd, lag(c_custkey, 1) OVER w AS before_it, lead(c_custkey, 2) OVER w AS after_it,
        first_value(c_custkey) OVER w AS first_it, nth_value(c_custkey, 3) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS third,
        count(*) OVER (PARTITION BY c_mktsegment ORDER BY c_nationkey RANGE BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near, sum(c_nationkey) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS run
        FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)""",
        None,
    ),
    "sql_aggregates_suite": (
        """SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, sum(CAST(l_quantity AS BIGINT)) AS quantity, round(avg(l_discount), 6) AS discount, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
        count(*) FILTER (WHERE l_tax > 0.04) AS taxed, coalesce(sum(CASE WHEN l_quantity > 100 THEN l_quantity END), 0.0) AS total_or_zero, bool_or(l_quantity > 49) AS any_large FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""",
        None,
    ),
    "sql_strings_dates_json": (
        """SELECT event_id, upper(substr(event_type, 2, 3)) AS part, length(props) AS len, instr(props, 'k') AS at, replace(event_type, 'e', 'E') AS rep, trim(concat('  ', event_type, ' ')) AS trimmed, event_type || '-' || CAST(user_id AS STRING) AS joined,
        hex(event_type) AS hexed, format_string('%05d', event_id) AS padded, year(ts) AS y, month(ts) AS m, day(ts) AS d, date_format(ts, 'yyyy-MM-dd') AS day_text, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, abs(-value) AS a, round(value, 1) AS r,
        greatest(value, 3.0D) AS g, least(value, 3.0D) AS l, CASE WHEN event_type LIKE 'p%' THEN 1 ELSE 0 END AS liked FROM events""",
        """SELECT event_id, upper(substr(event_type, 2, 3)) AS part, length(props) AS len, instr(props, 'k') AS at, replace(event_type, 'e', 'E') AS rep, trim(concat('  ', event_type, ' ')) AS trimmed, event_type || '-' || user_id AS joined,
        hex(event_type) AS hexed, printf('%05d', event_id) AS padded, year(ts) AS y, month(ts) AS m, day(ts) AS d, strftime(ts, '%Y-%m-%d') AS day_text, json_extract_string(props, '$.k')::BIGINT AS k, abs(-value) AS a, round(value, 1) AS r,
        greatest(value, 3.0) AS g, least(value, 3.0) AS l, CASE WHEN event_type LIKE 'p%' THEN 1 ELSE 0 END AS liked FROM events""",
    ),
    "sql_json_aggregates": (
        """SELECT event_type, count(x.k) AS n, sum(x.k) AS total, array_join(array_sort(collect_set(CAST(x.k % 5 AS STRING))), ',') AS rests FROM (SELECT event_type, from_json(props, 'k BIGINT') AS x FROM events) t GROUP BY event_type""",
        """SELECT event_type, count(k) AS n, sum(k)::BIGINT AS total, array_to_string(list_sort(list(DISTINCT (k % 5)::VARCHAR)), ',') AS rests FROM (SELECT event_type, json_extract(props, '$.k')::BIGINT AS k FROM events) GROUP BY 1""",
    ),
    "sql_recursive": (
        """WITH RECURSIVE up(key, here, depth) AS (SELECT 'n' || CAST(n_nationkey AS STRING), 'n' || CAST(n_nationkey AS STRING), 0 FROM nation UNION ALL SELECT u.key, l.to_key, u.depth + 1 FROM up u JOIN (SELECT from_key, to_key FROM links WHERE kind = 'Contains') l ON l.from_key = u.here WHERE u.depth < 3)
        SELECT key, max(depth) AS depth, count(*) AS steps FROM up GROUP BY key""",
        """WITH RECURSIVE up(key, here, depth) AS (SELECT 'n' || n_nationkey, 'n' || n_nationkey, 0 FROM nation UNION ALL SELECT u.key, 'r' || n.n_regionkey, u.depth + 1 FROM up u JOIN nation n ON 'n' || n.n_nationkey = u.here WHERE u.depth < 3)
        SELECT key, max(depth) AS depth, count(*) AS steps FROM up GROUP BY key""",
    ),
    "sql_subqueries": (
        """WITH big AS (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY o_custkey) SELECT c.c_mktsegment, count(*) AS n, round(sum(b.top - (SELECT avg(o_totalprice) FROM orders)), 2) AS above FROM customer c JOIN big b ON b.o_custkey = c.c_custkey
        WHERE b.top > (SELECT avg(o_totalprice) FROM orders) AND c.c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY c.c_mktsegment ORDER BY n DESC, c_mktsegment LIMIT 3""",
        None,
    ),
    "sql_order_limit_offset": ("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC NULLS LAST, doc_id LIMIT 20 OFFSET 5", None),
}


def _plan(text: str):
    def run(t: Tables) -> DataFrame:
        sql.register(t.spark, t.sf_dir)
        return sql.run(t.spark, text)

    return run


for _name, (_spark, _duck) in _SUITE.items():
    ENTRIES[_name] = _plan(_spark), _duck or _spark


_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderpriority GROUPS BETWEEN"


@query(f"""SELECT o_orderkey, sum(o_orderkey) {_OVER} 1 PRECEDING AND 1 FOLLOWING)::BIGINT AS near, count(o_orderkey) {_OVER} 1 PRECEDING AND 1 FOLLOWING EXCLUDE CURRENT ROW) AS others,
  min(o_totalprice) {_OVER} UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP) AS least_before, max(o_totalprice) {_OVER} CURRENT ROW AND 2 FOLLOWING EXCLUDE TIES) AS most_after FROM orders""")
def groups_frames(t: Tables) -> DataFrame:
    """Each order among its customer's, in groups of one status and priority."""
    order, out = [F.col("o_orderstatus"), F.col("o_orderpriority")], t.raw("orders")
    for name, what, value, start, end, exclude in (
        ("near", "sum", "o_orderkey", -1, 1, None),
        ("others", "count", "o_orderkey", -1, 1, "current row"),
        ("least_before", "min", "o_totalprice", None, 0, "group"),
        ("most_after", "max", "o_totalprice", 0, 2, "ties"),
    ):
        out = windows.framed(out, name, what, value, ["o_custkey"], order, start, end, exclude)
    return out.select("o_orderkey", "near", "others", "least_before", "most_after")


@query("""SELECT event_id, j.key, CASE j.type WHEN 'VARCHAR' THEN 'text' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN j.value::VARCHAR ELSE lower(j.type) END AS type,
  CASE WHEN j.type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(j.value, '$') END AS atom, j.fullkey, j.path
  FROM (SELECT event_id, '{"at": {"type": "' || event_type || '", "user": ' || user_id || '}, "marks": [' || (event_id % 7) || ', [true, null]], "props": ' || coalesce(props, '{}') || '}' AS doc FROM events) e, json_tree(e.doc) j""")
def json_tree(t: Tables) -> DataFrame:
    """Every value of every event's nested record."""
    part = lambda x: F.lit(x) if x.startswith(('"', "{", "}", ",", "[", "]")) else F.col(x).cast("string")
    parts = [part('{"at": {"type": "'), part("event_type"), part('", "user": '), part("user_id"), part('}, "marks": ['), (F.col("event_id") % 7).cast("string"), part(', [true, null]], "props": '), F.coalesce("props", F.lit("{}")), part("}")]
    found = documents.json_tree(t.raw("events").select("event_id", F.concat(*parts).alias("doc")), "doc", ["event_id"])
    return found.select("event_id", "key", "type", "atom", "fullkey", "path")
