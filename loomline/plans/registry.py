"""The catalogue's registry, and fixtures that both engines derive from the tables by the same SQL text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A fixture's SQL, with its tables in braces, run by Spark."""
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in set(re.findall(r"\{(\w+)\}", text))})


def oracle_text(text: str) -> str:
    """The same fixture as text for the other engine, whose tables are views."""
    return re.sub(r"\{(\w+)\}", r"\1", text)


def query(source: str, sql: str | None = None, name: str | None = None) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Registers a function of one frame: source is a table or a fixture's SQL; sql selects from it under the name src."""

    def register(f: Callable[[DataFrame], DataFrame]) -> Callable:
        key = name or f.__name__
        text = source if " " in source else f"SELECT * FROM {{{source}}}"
        QUERIES[key] = lambda spark, sf_dir: f(fixture(spark, sf_dir, text))
        if sql is not None:
            inner = sql.strip()
            own = f"src AS ({oracle_text(text)})"
            ORACLE[key] = re.sub(r"(?i)^WITH( RECURSIVE)?", lambda m: f"WITH{m[1] or ''} {own},", inner, count=1) if re.match(r"(?i)WITH\b", inner) else f"WITH {own} {inner}"
        return f

    return register


# Messages as they are.
MESSAGES = "SELECT conv_id, turn, role, text AS content FROM {conversations}"

# Text with carriage returns, blanks at line ends and runs of empty lines.
RAGGED = "SELECT conv_id, turn, role, replace(text, '. ', '. ' || chr(13) || chr(10) || '   ' || chr(10) || chr(10) || chr(10)) || '  ' AS content FROM {conversations}"

# Code in fences, one text per part: imports, comments, definitions, tabs and a second block.
CODE = """SELECT p_partkey AS id, CAST(p_partkey % 40 AS BIGINT) AS conv_id, CAST(floor(p_partkey / 40) AS BIGINT) AS turn, p_brand AS brand,
    'Please fix ' || p_name || chr(10) || '```python' || chr(10) || '# ' || p_type || chr(10) || 'import sys' || chr(10) || 'import os  ' || chr(10) || 'from re import sub' || chr(10) || chr(10)
    || 'def run_' || CAST(p_partkey % 13 AS STRING) || '(x):' || chr(10) || chr(9) || 'return ' || CAST(p_size AS STRING) || chr(10) || 'class Box' || CAST(p_partkey % 5 AS STRING) || ':' || chr(10) || '    size = ' || CAST(p_size AS STRING) || chr(10) || '```' || chr(10) || 'and then' || chr(10)
    || CASE WHEN p_partkey % 3 = 0 THEN '```js' || chr(10) || 'import a from ''./lib/b' || CAST(p_partkey % 4 AS STRING) || '''' || chr(10) || 'function go_' || CAST(p_partkey % 7 AS STRING) || '() ' || chr(123) || chr(10) || '  const k = 1;' || chr(10) || chr(125) || chr(10) || '```' || chr(10) ELSE '' END
    || CASE WHEN p_partkey % 7 = 0 THEN '```' || chr(10) || 'open' ELSE 'done.' END AS content
    FROM {part}"""

# Bare code of the first block.
BARE_CODE = """SELECT p_partkey AS id, 'import sys  ' || chr(10) || 'import os' || chr(10) || '# note' || chr(10) || chr(10) || 'from z import a' || chr(10) || 'from b import c' || chr(10) || 'def run_' || CAST(p_partkey % 13 AS STRING) || '(x):  ' || chr(10) || '    y = ' || CAST(p_size AS STRING) || chr(10) || chr(10) || '    # keep' || chr(10) || '    return y' || chr(10) || 'class Box' || CAST(p_partkey % 5 AS STRING) || ':' || chr(10) || '    pass' AS content FROM {part}"""

# Fields that vary between turns.
VOLATILE_TEXT = "SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'tool' ELSE 'user' END AS role, 'at ' || CAST(ts AS STRING) || ' id ' || substr(md5(CAST(event_id AS STRING)), 1, 8) || '-' || substr(md5(CAST(event_id AS STRING)), 9, 4) || '-' || substr(md5(CAST(event_id AS STRING)), 13, 4) || '-' || substr(md5(CAST(event_id AS STRING)), 17, 4) || '-' || substr(md5(CAST(event_id AS STRING)), 21, 12) || ' commit ' || md5(CAST(user_id AS STRING)) || ' by ' || CAST(user_id AS STRING) AS content FROM {events}"

# Logs of tools: a header, repeated lines, sometimes frames, an error, noise and a verdict.
LOGS = """SELECT event_id AS log_id, user_id AS conv_id, event_type AS tool,
    '$ run ' || event_type || chr(10) || 'collecting cases' || chr(10) || repeat('case ' || event_type || ' PASSED' || chr(10), CAST(event_id % 9 AS INT))
    || CASE WHEN event_id % 4 = 0 THEN '  File "app/x.py", line ' || CAST(event_id % 5 AS STRING) || ', in run' || chr(10) || '  File "app/y.py", line 7, in go' || chr(10) || 'ValueError: bad ' || CAST(user_id AS STRING) || chr(10) || 'detail one' || chr(10) || 'again' || chr(10) || '  File "app/x.py", line ' || CAST(event_id % 5 AS STRING) || ', in run' || chr(10) || '  File "app/y.py", line 7, in go' || chr(10) ELSE '' END
    || chr(27) || '[32mstep ' || CAST(event_id % 100 AS STRING) || chr(27) || '[0m' || chr(10) || repeat('-', 20) || chr(10) || 'filler line a' || chr(10) || 'filler line b' || chr(10) || 'filler line c' || chr(10) || 'filler line d' || chr(10) || repeat('.', 30) || chr(10)
    || CASE WHEN event_id % 4 = 0 THEN 'test case failed' || chr(10) ELSE '' END
    || CASE WHEN event_id % 5 = 1 THEN 'Build succeeded' || chr(10) WHEN event_id % 5 = 2 THEN 'On branch main' || chr(10) || 'nothing to commit' || chr(10) ELSE '' END
    || CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 9 AS STRING) || ' passed in 1s' || chr(10) ELSE '' END
    || CASE WHEN event_id % 7 = 3 THEN 'ok  ' || chr(9) || 'example.org/' || event_type || chr(9) || '0.012s' || chr(10) ELSE '' END || CASE WHEN event_id % 14 = 3 THEN 'FAIL' || chr(9) || 'example.org/y' || chr(9) || '0.010s' || chr(10) ELSE '' END
    || 'end of ' || event_type AS text
    FROM {events}"""

# Steps of agent sessions: a session per user, in the order of event_id.
STEPS = """SELECT user_id AS conv_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS step_index, event_id, ts,
    CASE event_id % 5 WHEN 0 THEN 'user' WHEN 1 THEN 'tool' WHEN 2 THEN 'assistant' WHEN 3 THEN 'tool' ELSE 'thinking' END AS role,
    CASE WHEN event_id % 5 IN (1, 3) THEN event_type END AS tool_name,
    CASE event_id % 5 WHEN 0 THEN 'Please update ' || event_type || ' number ' || CAST(event_id % 11 AS STRING) WHEN 1 THEN '# Subtask: load ' || event_type || chr(10) || 'value ' || CAST(event_id % 17 AS STRING)
        WHEN 2 THEN CASE event_id % 3 WHEN 0 THEN 'I will create ' || event_type WHEN 1 THEN 'now fixing ' || event_type ELSE 'search ' || event_type || ' completed' END
        WHEN 3 THEN 'result of ' || event_type || ' is ' || CAST(event_id % 7 AS STRING) ELSE 'thinking about ' || event_type END AS content
    FROM {events}"""

# Request traces, a session per user.
TRACES = """SELECT user_id AS session_id, event_id AS request_id, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS turn, event_type AS stage,
    CAST(500 + event_id % 4000 AS BIGINT) AS raw_tokens, CAST(400 + event_id % 2500 AS BIGINT) AS prompt_tokens, CAST((event_id * 37) % (400 + event_id % 2500) AS BIGINT) AS cached_tokens,
    CAST(20 + event_id % 300 AS BIGINT) AS completion_tokens, CAST(200 + (event_id * 13) % 9000 AS DOUBLE) AS latency_ms, CAST(50 + (event_id * 7) % 3000 AS DOUBLE) AS ttft_ms,
    CAST((event_id * 31) % 101 AS DOUBLE) / 100 AS quality, CAST((event_id * 17) % 101 AS DOUBLE) / 100 AS code_ratio
    FROM {events}"""
