"""Inputs that the queries derive from the given tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ATTEMPT_LOG = """
SELECT o_orderkey AS task, o_orderpriority AS model,
  CASE WHEN (o_orderkey + 1) % 32 = 0 THEN 5 WHEN (o_orderkey + 1) % 16 = 0 THEN 4 WHEN (o_orderkey + 1) % 8 = 0 THEN 3
       WHEN (o_orderkey + 1) % 4 = 0 THEN 2 WHEN (o_orderkey + 1) % 2 = 0 THEN 1 ELSE 0 END AS attempt,
  CASE WHEN o_orderstatus <> 'F' THEN 'pass' ELSE 'fail' END AS status
FROM orders"""

RUNS = """
SELECT l_orderkey AS task, l_linenumber - 1 AS attempt, max(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS returncode
FROM lineitem GROUP BY l_orderkey, l_linenumber"""

_HEAD = "'Traceback (most recent call last):' || chr(10) || '  File \"/usr/lib/python3/runpy.py\", line 196, in run' || chr(10)"
_MAIN = "'  File \"/usr/src/app/main.py\", line ' || cast(event_id % 90 AS STRING) || ', in <module>' || chr(10)"
_TB = f"{_HEAD} || {_MAIN}"
_GENERIC = f"{_HEAD} || '  File \"/usr/src/app/main.py\", line 99, in guard' || chr(10) || 'Exception: This is a generic error message.'"
_UNIT = (
    "CASE WHEN event_id % 3 = 0 THEN '..F' WHEN event_id % 3 = 1 THEN '.F.' ELSE 'F' END || chr(10) || '======' || chr(10) || 'FAIL: test_it (main.T.test_it)' || chr(10) || '------' || chr(10) || "
    f"{_TB} || '    self.assertEqual(f(' || cast(event_id AS STRING) || '), 2)' || chr(10) || 'AssertionError: 1 != 2' || chr(10) || chr(10) || '------' || chr(10) || 'Ran 3 tests in 0.004s' || chr(10) || chr(10) || 'FAILED (failures=1)'"
)
#: Program output of nine kinds, one for each remainder of the event's id.
STDERR_LOG = f"""
SELECT event_id, CASE event_id % 9
  WHEN 0 THEN {_TB} || '    foo(x' || cast(event_id AS STRING) || ')' || chr(10) || 'NameError: name ''x' || cast(event_id AS STRING) || ''' is not defined'
  WHEN 1 THEN {_TB} || '    assert candidate(' || cast(event_id AS STRING) || ') == ' || event_type || chr(10) || 'AssertionError'
  WHEN 2 THEN {_TB} || '    f(n)' || chr(10) || 'RecursionError: maximum recursion depth exceeded'
  WHEN 3 THEN {_TB} || '    int(''a'')' || chr(10) || 'ValueError: invalid literal: ''' || event_type || '''' || chr(10) || chr(10) || {_GENERIC}
  WHEN 4 THEN {_UNIT}
  WHEN 5 THEN {_TB} || '    run()' || chr(10) || 'Exception: Generated code is running infinite loop'
  WHEN 6 THEN 'all good ' || cast(event_id AS STRING) || chr(10)
  WHEN 7 THEN 'Process Process-' || cast(event_id AS STRING) || ':' || chr(10) || {_TB} || '    d[''é'']' || chr(10) || 'KeyError: ''é' || event_type || ''''
  ELSE {_TB} || '    go()' || chr(10) || 'Exception: stopped at ' || event_type END AS stderr
FROM events"""

RESPONSES = """
SELECT item_id, CASE item_id % 5
  WHEN 0 THEN '### Requirements' || chr(10) || 'none' || chr(10) || '### Code' || chr(10) || '```python' || chr(10) || 'def f():' || chr(10) || '    return ' || cast(item_id AS STRING) || chr(10) || '```'
  WHEN 1 THEN '### Requirements' || chr(10) || 'pandas, numpy , ' || chr(10) || '### Code' || chr(10) || '```' || chr(10) || text || chr(10) || '```' || chr(10) || 'done'
  WHEN 2 THEN 'Here: [PYTHON]' || chr(10) || text || '[' || chr(92) || 'PYTHON] end'
  WHEN 3 THEN 'Sure.' || chr(10) || '```python' || chr(10) || 'x = ' || cast(item_id AS STRING) || chr(10) || '```' || chr(10) || '### Example' || chr(10) || '```' || chr(10) || 'f(x)' || chr(10) || '```'
  ELSE text END AS response
FROM benchmark"""

CALLS = """
SELECT p_partkey AS call_id, CASE p_partkey % 6
  WHEN 0 THEN 'foo(' || cast(p_partkey AS STRING) || ', ' || cast(p_size AS STRING) || ')'
  WHEN 1 THEN 'int(foo(' || cast(p_size AS STRING) || '))'
  WHEN 2 THEN 'assert foo(' || cast(p_size AS STRING) || ') == ' || cast(p_partkey AS STRING)
  WHEN 3 THEN '(bar([1, 2], Root(' || cast(p_size AS STRING) || ')))'
  WHEN 4 THEN 'baz(''' || p_brand || ''', {''a'': 1}, other)'
  ELSE p_name END AS call
FROM part"""

#: Progress of a download for each type of event, in the order of time; its size is 1000 MB.
PULLS = """
SELECT event_type AS model, 'pulling' AS status, (event_id * 7919) % 1000 * 1048576 AS completed, cast(1000 * 1048576 AS BIGINT) AS total, ts AS happened
FROM events"""


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """The query's rows over these tables of the folder."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    # Braces of the query itself are doubled for the formatter, those of tables aren't.
    held = {t: f"\0{t}\0" for t in tables}
    for t, mark in held.items():
        sql = sql.replace(f"{{{t}}}", mark)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for t, mark in held.items():
        sql = sql.replace(mark, f"{{{t}}}")
    return spark.sql(sql, **frames)
