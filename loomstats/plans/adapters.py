"""The given parquet tables seen as usage telemetry.

Each adapter is a projection written once as SQL text that Spark and the checking engine both understand; only the
timestamp functions differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

C = F.col

AS_OF = "2024-01-31"
THREAD_GAP_MS = 12 * 3_600_000
EPISODE_GAP_MS = 6 * 3_600_000
PAUSE_MS = 12 * 3_600_000

SPARK = {
    "ms": "unix_millis(CAST({0} AS TIMESTAMP))",
    "day": "date_format({0}, 'yyyy-MM-dd')",
    "stamp": "date_format({0}, 'yyyy-MM-dd HH:mm:ss.SSS')",
}
DUCK = {
    "ms": "(epoch_us({0}) // 1000)",
    "day": "strftime({0}, '%Y-%m-%d')",
    "stamp": "strftime({0}, '%Y-%m-%d %H:%M:%S.%g')",
}


def _fill(text: str, dialect: dict[str, str]) -> str:
    for name in dialect:
        text = text.replace(f"{{{name}:ts}}", dialect[name].format("ts"))
    return text


_BASE = "event_id, ts, user_id, event_type AS et, value, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k"

_INTENT = (
    "CASE WHEN et = 'signup' THEN CASE k % 6 WHEN 0 THEN 'vscodePrompt' WHEN 1 THEN 'panel/unknown' "
    "WHEN 2 THEN 'tool/runSubagent' WHEN 3 THEN 'tool/searchSubagentTool' WHEN 4 THEN 'apply_patch' "
    "ELSE 'thread-title' END WHEN et = 'view' AND k % 2 = 1 THEN 'fetchCompletions' ELSE '' END"
)
_ACTOR = (
    "CASE WHEN et = 'signup' THEN CASE k % 6 WHEN 0 THEN 'human' WHEN 5 THEN 'system' ELSE 'ai' END "
    "WHEN et = 'error' THEN 'system' WHEN et = 'view' AND k % 2 = 1 THEN 'ai' ELSE '' END"
)
_PHASE = (
    "CASE WHEN et = 'signup' THEN CASE k % 6 WHEN 0 THEN 'human' WHEN 1 THEN 'planning' WHEN 2 THEN 'execution' "
    "WHEN 3 THEN 'research' WHEN 4 THEN 'execution' ELSE 'planning' END "
    "WHEN et = 'error' AND k % 3 = 0 THEN 'memory' WHEN et = 'error' THEN 'execution' "
    "WHEN et = 'view' AND k % 2 = 1 THEN 'execution' ELSE '' END"
)
TE_COLUMNS = {
    "seq": "event_id",
    "session_id": "concat('u', CAST(user_id AS STRING))",
    "ts": "ts",
    "ms": "{ms:ts}",
    "date": "{day:ts}",
    "event_type": (
        "CASE et WHEN 'click' THEN 'textChange' WHEN 'purchase' THEN 'completionAccept' "
        "WHEN 'view' THEN CASE WHEN k % 2 = 0 THEN 'editorSwitch' ELSE 'sessionSignal' END ELSE 'sessionSignal' END"
    ),
    "signal_type": (
        "CASE WHEN et = 'view' AND k % 2 = 1 THEN 'completion-shown' "
        "WHEN et = 'signup' THEN CASE k % 6 WHEN 1 THEN 'plan-proposal' WHEN 5 THEN 'thread-title' "
        "ELSE 'chat-request' END "
        "WHEN et = 'error' THEN CASE WHEN k % 3 = 0 THEN 'memory-boundary' ELSE 'tool-loop-stop' END ELSE '' END"
    ),
    "intent": _INTENT,
    "actor": _ACTOR,
    "phase": _PHASE,
    "language_id": (
        "CASE k % 5 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'go' WHEN 3 THEN 'rust' ELSE '' END"
    ),
    "model_name": "CASE WHEN k % 7 = 6 THEN '' ELSE concat('model-', CAST(k % 7 AS STRING)) END",
    "chars_added": "CASE WHEN et = 'click' THEN CAST(floor(value) AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "chars_deleted": "CASE WHEN et = 'click' THEN CAST(k AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "accepted_characters": "CASE WHEN et = 'purchase' THEN CAST(floor(value) AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "latency_ms": "CASE WHEN et = 'purchase' THEN CAST(floor(value) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
    "file_path": "CASE WHEN k % 10 = 9 THEN '' ELSE concat('file', CAST(k % 10 AS STRING)) END",
    "raw_text": "concat(et, ' ', CAST(k AS STRING))",
}

# Usage records: line items as model calls of a session (the order) inside a project (the customer's nation).
CU_COLUMNS = {
    "session_id": "CAST(l_orderkey AS STRING)",
    "project": "CASE WHEN c_nationkey % 5 = 4 THEN NULL ELSE concat('/p/', CAST(c_nationkey AS STRING)) END",
    "sequence": "CAST(l_linenumber AS BIGINT)",
    "ship_ms": "{ms:ts}",
    "call_date": "{day:ts}",
    "tie1": "l_partkey",
    "tie2": "l_suppkey",
    "tie3": "l_extendedprice",
    "model": "concat('model-', CAST(l_partkey % 5 AS STRING))",
    "input_tokens": "CAST(l_quantity * 100 AS BIGINT)",
    "output_tokens": "CAST(l_quantity * 10 AS BIGINT)",
    "nano": (
        "CASE WHEN l_returnflag = 'R' THEN NULL "
        "ELSE CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(100000 AS BIGINT) END"
    ),
    "duration_ms": "l_extendedprice / 10",
    "first_token_ms": "CASE WHEN l_discount = 0 THEN NULL ELSE l_discount * 1000 END",
    "is_checkpoint": "l_linestatus = 'F' AND l_linenumber % 3 = 0",
}


def _project(columns: dict[str, str], dialect: dict[str, str]) -> list[str]:
    return [f"{_fill(sql, dialect)} AS {name}" for name, sql in columns.items()]


def _duck(text: str) -> str:
    return text.replace("AS STRING", "AS VARCHAR")


TE_SQL = _duck(f"te AS (SELECT {', '.join(_project(TE_COLUMNS, DUCK))} FROM (SELECT {_BASE} FROM events) base)")
RAW_SQL = f"raw AS (SELECT {_BASE} FROM events)"
CU_SQL = _duck(
    f"cu AS (SELECT {', '.join(_project(CU_COLUMNS, DUCK))} FROM (SELECT *, l_shipdate AS ts FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey) base)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use all cores where a small file gives fewer splits than there are cores; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*_split(_BASE))


def _split(columns: str) -> list[str]:
    """Split a select list at its top-level commas."""
    parts, depth = [""], 0
    for char in columns:
        depth += {"(": 1, ")": -1}.get(char, 0)
        if char == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += char
    return [p.strip() for p in parts]


def tracked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = raw_events(spark, sf_dir).selectExpr(*_project(TE_COLUMNS, SPARK))
    return events.withColumn("ts", events["ts"].cast("timestamp"))


def usage_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders, customer = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "customer"))
    # Orders meet their customers first: the lines, by far the most rows, are exchanged once.
    owned = orders.join(customer, C("o_custkey") == C("c_custkey"))
    joined = spread(lines).join(owned, C("l_orderkey") == C("o_orderkey"))
    return joined.withColumn("ts", C("l_shipdate")).selectExpr(*_project(CU_COLUMNS, SPARK))
