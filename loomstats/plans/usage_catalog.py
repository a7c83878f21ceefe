"""Queries over CLI usage: deduplication, credits, checkpoints, projects, prompts, tools, permissions and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings
from ..operators import messages, runs, usage
from .adapters import CU_SQL, DUCK, RAW_SQL, SPARK, _fill, _duck, raw_events, table, usage_records

C = F.col
ORDER = ["ship_ms", "tie1", "tie2", "tie3"]
STEPS = [*ORDER, "part"]
AS_OF = "1998-06-15"


# --- Usage records ---------------------------------------------------------------------------------------------------


def records(spark, sf):
    """Usage records with repeated (session, sequence) pairs removed."""
    cu = usage_records(spark, sf)
    source = C("session_id")
    key = usage.dedup_key(source, F.lit(None).cast("string"), C("sequence"), F.lit(None).cast("string"))
    return usage.first_per_key(cu.withColumn("key", key), ["session_id"], "key", ORDER)


_MARK_FIELDS = {
    "model": "string", "input_tokens": "long", "output_tokens": "long", "nano": "long", "source": "string",
    "sequence": "long", "total_nano": "long", "complete": "boolean",
}


def _mark(part, kind, **values):
    """One row of a checkpoint; fields of the other kinds are null."""
    fields = [values.get(name, F.lit(None)).cast(type_).alias(name) for name, type_ in _MARK_FIELDS.items()]
    return F.struct(F.lit(part).alias("part"), F.lit(kind).alias("kind"), *fields)


def usage_events(spark, sf):
    """Records and, for every third line of a finished order, a checkpoint."""
    cu = usage_records(spark, sf)
    common = ["session_id", *ORDER]
    plain = cu.where(~C("is_checkpoint"))
    key = F.concat_ws(":", "session_id", C("sequence").cast("string"))
    unique = usage.first_per_key(plain.withColumn("key", key), ["session_id"], "key", ORDER).select(
        *common, F.lit(0).alias("part"), F.lit("record").alias("kind"), "model", "input_tokens", "output_tokens", "nano",
        C("session_id").alias("source"), "sequence",
    )
    third = C("sequence") == 3
    rows = F.array(
        _mark(0, "model", model=C("model"), input_tokens=C("input_tokens"),
              output_tokens=F.when(third, C("output_tokens")), nano=C("nano")),
        _mark(1, "snapshot", total_nano=F.when(third, C("nano") * 2), complete=C("tie1") % 11 != 0),
        _mark(2, "watermark", source=C("session_id"), sequence=C("sequence")),
    )
    marks = cu.where("is_checkpoint").select(*common, F.inline(rows))
    return unique.unionByName(marks, allowMissingColumns=True)


def _sums(df, *keys):
    return usage.usage_by(df, *keys).select(*keys, "calls", "input_tokens", "output_tokens", "nano")


def _unattributed(spark, sf):
    """As recorded, where one unknown credit makes the difference unknown, and with unknown credits as none."""
    events = settings.cut_lineage(usage_events(spark, sf))
    found = usage.unattributed(usage.model_totals(events, STEPS, kept=True), events.where(C("kind") == "record"))
    bases = [
        F.struct("unattributed_tokens", F.round(credits, 4).alias("unattributed_credits"), F.lit(basis).alias("basis"))
        for basis, credits in (("recorded", "unattributed_credits"), ("filled", "filled_credits"))
    ]
    rows = found.select(F.explode(F.array(*bases)).alias("row"))
    return rows.select("row.unattributed_tokens", "row.unattributed_credits", "row.basis")


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 4) for n in names})


# --- Messages --------------------------------------------------------------------------------------------------------

_DAY = "concat('2024-01-', lpad(CAST({0} % 28 + 1 AS STRING), 2, '0'))"
CH_COLUMNS = {
    "conv_id": "conv_id",
    "session_id": "concat('c', CAST(conv_id AS STRING))",
    "time": "turn",
    "seq": "turn",
    "date": _DAY.format("conv_id"),
    "kind": (
        "CASE WHEN role = 'system' THEN 'start' WHEN role = 'user' AND turn % 4 = 2 THEN 'agent' "
        "WHEN role = 'user' THEN 'prompt' ELSE 'reply' END"
    ),
    "message_id": "CASE WHEN role = 'user' AND turn % 3 <> 0 THEN concat('m', CAST(turn AS STRING)) END",
    "origin_id": (
        "CASE WHEN role = 'assistant' THEN CASE WHEN conv_id % 5 = 3 THEN NULL WHEN conv_id % 7 = 5 THEN 'zz' "
        "ELSE concat('m', CAST(turn - 1 AS STRING)) END END"
    ),
    "parent_tool_call": "CASE WHEN role = 'assistant' AND conv_id % 11 = 7 THEN 'x' END",
    "content": "CASE WHEN role = 'assistant' AND conv_id % 4 = 1 THEN '' ELSE text END",
    "output_tokens": "CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) ELSE CAST(0 AS BIGINT) END",
    "usage_tokens": "CASE WHEN role = 'assistant' THEN CAST(length(text) AS BIGINT) END",
    "has_tool_requests": "role = 'assistant' AND conv_id % 8 = 1",
    "title_kind": (
        "CASE WHEN role = 'system' THEN 'start' WHEN role = 'assistant' AND turn = 1 AND conv_id % 6 = 0 THEN 'title' "
        "WHEN role = 'user' THEN 'prompt' ELSE 'reply' END"
    ),
    "title_content": (
        "CASE WHEN role = 'system' AND conv_id % 9 <> 0 THEN NULL ELSE text END"
    ),
}
CH_SQL = _duck("ch AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in CH_COLUMNS.items()) + " FROM conversations)")


def chat_messages(spark, sf):
    return table(spark, sf, "conversations").selectExpr(*[f"{v} AS {k}" for k, v in CH_COLUMNS.items()])


def _titles(spark, sf):
    rows = chat_messages(spark, sf).select(
        "session_id", "time", "seq", C("title_kind").alias("kind"), C("title_content").alias("content")
    )
    return messages.session_titles(rows)


def _daily_prompts(spark, sf):
    prompts = chat_messages(spark, sf).where(C("kind").isin("prompt", "reply")).groupBy("session_id", "date").agg(
        F.count_if(C("kind") == "prompt").alias("prompts"), F.sum("output_tokens").alias("output_tokens")
    )
    calls = records(spark, sf).selectExpr(
        "concat('c', session_id) AS session_id", _DAY.format("CAST(session_id AS BIGINT)") + " AS date", "output_tokens"
    )
    recorded = calls.groupBy("session_id", "date").agg(F.sum("output_tokens").alias("usage_output"))
    return usage.daily_prompts(prompts, recorded)


def _meaningful(spark, sf):
    """Turns with prompts, tokens, runs, decisions, or credits that are unknown or positive."""
    sums = chat_messages(spark, sf).groupBy("session_id", "conv_id", "seq").agg(
        F.count_if(C("kind").isin("prompt", "agent")).alias("prompts"),
        F.coalesce(F.sum("usage_tokens"), F.lit(0)).alias("tokens"),
    ).withColumn("nano", F.when(C("conv_id") % 4 != 0, C("conv_id") % 4 - 1))
    runs_, decisions = (F.when(C("conv_id") % n == 1, 1).otherwise(0) for n in (6, 10))
    wanted = messages.is_meaningful(C("prompts"), C("tokens"), C("nano"), runs_, decisions)
    return sums.where(wanted).select("session_id", "seq", "prompts", "tokens", "nano")


def _attached(spark, sf):
    threads = raw_events(spark, sf).where("et = 'error'").selectExpr(
        "concat('g', CAST(user_id % 10 AS STRING)) AS session_id", "event_id AS position"
    )
    details = threads.groupBy("session_id").agg(F.count(F.lit(1)).alias("details"))
    return runs.attach_once(threads, details)


# --- Events of sessions ----------------------------------------------------------------------------------------------

_BASE = {"session_id": "concat('u', CAST(user_id AS STRING))", "time": "{ms:ts}", "seq": "event_id"}
VIEWS = {
    "calls": (
        {
            "call_id": "CASE WHEN k % 9 <> 1 THEN CAST(k AS STRING) END",
            "kind": "CASE et WHEN 'signup' THEN 'start' ELSE 'complete' END",
            "name": (
                "CASE WHEN et = 'signup' THEN concat('tool-', CAST(k % 6 AS STRING)) WHEN k % 4 = 0 THEN 'own' END"
            ),
            "success": "CASE WHEN k % 5 <> 0 THEN k % 3 <> 0 END",
            "model": "concat('model-', CAST(k % 7 AS STRING))",
        },
        "et IN ('signup', 'purchase')",
    ),
    "models": (
        {
            "kind": "CASE et WHEN 'signup' THEN 'start' WHEN 'click' THEN 'change' ELSE 'message' END",
            "model": (
                "CASE WHEN k % 7 = 6 OR (et = 'purchase' AND k % 5 <> 0) THEN NULL "
                "ELSE concat('model-', CAST(k % 7 AS STRING)) END"
            ),
        },
        "et IN ('signup', 'click', 'purchase')",
    ),
    "dated": (
        {
            "kind": "CASE WHEN et = 'signup' THEN 'start' ELSE 'other' END",
            "date": "CASE WHEN et = 'signup' OR k % 2 = 0 THEN {day:ts} END",
        },
        "et IN ('signup', 'click')",
    ),
    "agents": ({"agent_name": "concat('agent-', CAST(k % 4 AS STRING))"}, "et = 'signup'"),
    "activity": (
        {"kind": "CASE et WHEN 'purchase' THEN 'message' WHEN 'view' THEN 'turn' WHEN 'click' THEN 'change' ELSE '' END"},
        "true",
    ),
    "spans": (
        {
            "call_id": "CASE WHEN k % 9 <> 1 THEN CAST(k AS STRING) END",
            "kind": "CASE et WHEN 'signup' THEN 'started' ELSE 'completed' END",
            "agent_name": "CASE WHEN et = 'signup' AND k % 8 <> 0 THEN concat('agent-', CAST(k % 4 AS STRING)) END",
            "parent_id": "CASE WHEN k % 2 = 0 THEN concat('p', CAST(k AS STRING)) END",
            "model": "CASE WHEN k % 7 <> 6 THEN concat('model-', CAST(k % 7 AS STRING)) END",
            "duration_ms": "CASE WHEN et = 'error' THEN CAST(floor(value) AS BIGINT) - 50 END",
        },
        "et IN ('signup', 'error')",
    ),
    "compactions": (
        {
            "trigger": "CASE WHEN k % 2 = 0 THEN 'auto' ELSE 'manual' END",
            "success": "CASE WHEN k % 3 <> 0 THEN k % 3 = 1 END",
            "before_tokens": "CASE WHEN k % 10 = 9 THEN CAST(-1 AS BIGINT) ELSE CAST(k * 10 AS BIGINT) END",
            "after_tokens": "CAST(floor(value) AS BIGINT)",
        },
        "et = 'view'",
    ),
    "notes": (
        {
            "kind": "CASE et WHEN 'click' THEN 'steering' ELSE 'stop' END",
            "ms": "CASE WHEN k % 20 <> 1 THEN {ms:ts} END",
        },
        "et IN ('click', 'error')",
    ),
    "ids": ({"key": "CASE WHEN k % 10 <> 0 THEN concat('e', CAST(k AS STRING)) END"}, "true"),
    "decisions": (
        {
            "request_id": "CAST(k AS STRING)",
            "kind": "CASE et WHEN 'signup' THEN 'request' ELSE 'response' END",
            "ms": "CASE WHEN k % 13 <> 0 THEN {ms:ts} END",
            "permission_kind": "CASE k % 4 WHEN 0 THEN 'shell' WHEN 1 THEN 'write' WHEN 3 THEN 'read' END",
            "call_id": "CASE WHEN k % 3 <> 0 THEN concat('c', CAST(k % 30 AS STRING)) END",
            "tool_name": "CASE WHEN k % 6 = 0 THEN 'own' END",
            "decision_source": "CASE k % 3 WHEN 0 THEN 'human_response' WHEN 1 THEN 'host_policy' ELSE 'other' END",
            "result": "CASE WHEN k % 2 = 0 THEN 'approved' ELSE 'denied' END",
        },
        "et IN ('signup', 'purchase')",
    ),
    "names": (
        {
            "call_id": "concat('c', CAST(k % 30 AS STRING))",
            "tool_name": "CASE WHEN k % 9 <> 0 THEN concat('tool-', CAST(k % 5 AS STRING)) END",
        },
        "et = 'click'",
    ),
}


def _columns(name, dialect):
    return [f"{_fill(v, dialect)} AS {k}" for k, v in {**_BASE, **VIEWS[name][0]}.items()]


def view(spark, sf, name):
    return raw_events(spark, sf).where(VIEWS[name][1]).selectExpr(*_columns(name, SPARK))


def _view_sql(name):
    return _duck(f"{name} AS (SELECT {', '.join(_columns(name, DUCK))} FROM raw WHERE {VIEWS[name][1]})")


def _permissions(spark, sf):
    return runs.permissions(view(spark, sf, "decisions"), view(spark, sf, "names"))


def _by_project(spark, sf):
    rows = _permissions(spark, sf).withColumn("project", F.substring("session_id", -1, 1))
    return runs.permission_summary(rows, ["project"], "2024-01-03", "2024-01-25")


# --- Runs ------------------------------------------------------------------------------------------------------------

FR_COLUMNS = {
    "run_id": "o_orderkey",
    "phase_id": "l_linenumber",
    "time": "{ms:ts}",
    "seq": "l_partkey * 1000000 + l_suppkey",
    "ms": "CASE WHEN o_orderkey % 17 <> 0 THEN {ms:ts} END",
    "kind": (
        "CASE l_linenumber WHEN 1 THEN 'primary' WHEN 2 THEN 'judge' WHEN 3 THEN 'repair' "
        "ELSE concat('phase-', CAST(l_linenumber AS STRING)) END"
    ),
    "request_count": "CAST(1 AS BIGINT)",
    "input_tokens": "CAST(l_quantity * 100 AS BIGINT)",
    "output_tokens": "CAST(l_quantity * 10 AS BIGINT)",
    "cached_tokens": "CAST(l_linenumber AS BIGINT)",
    "cache_write_tokens": "CAST(0 AS BIGINT)",
    "nano": (
        "CASE WHEN l_returnflag = 'R' AND o_orderkey % 4 = 1 THEN NULL "
        "ELSE CAST(round(l_extendedprice * 100) AS BIGINT) * CAST(100000 AS BIGINT) END"
    ),
}
_FR_SQL = _duck(
    "fr0 AS (SELECT " + ", ".join(f"{_fill(v, DUCK)} AS {k}" for k, v in FR_COLUMNS.items())
    + " FROM (SELECT *, l_shipdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey) b), "
    "fr AS (SELECT * FROM fr0 QUALIFY row_number() OVER (PARTITION BY run_id, phase_id ORDER BY time, seq) = 1)"
)
RUN_RANGE = ("1996-01-01", "1999-12-31")


def phases(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).withColumn("ts", lines.l_shipdate)
    return joined.selectExpr(*[f"{_fill(v, SPARK)} AS {k}" for k, v in FR_COLUMNS.items()])


def _completions(first):
    """Recorded totals of the runs: exact, one short for every tenth run, missing for some."""
    sums = first.groupBy("run_id").agg(*[F.sum(f).alias(f) for f in runs.RUN_FIELDS])
    tenth = C("run_id") % 10
    changed = {f: F.when(tenth == 0, C(f) - 1).when(tenth != 1, C(f)) for f in runs.RUN_FIELDS}
    return sums.where(C("run_id") % 5 != 3).withColumns(changed)


def _runs(spark, sf):
    all_phases = phases(spark, sf)
    first = runs.first_phases(all_phases)
    return runs.runs(first, _completions(first), all_phases.select("run_id", "ms")), first


QUERIES = {
    "q_usage_dedup": lambda s, d: records(s, d).select(
        "session_id", "sequence", "call_date", "model", "input_tokens", "nano"
    ),
    "q_usage_by_model": lambda s, d: _sums(records(s, d), "model"),
    "q_usage_by_day": lambda s, d: _sums(records(s, d), "call_date"),
    "q_usage_by_thread": lambda s, d: _sums(records(s, d), "session_id", "project"),
    "q_usage_by_project_day": lambda s, d: _sums(records(s, d), "project", "call_date"),
    "q_top_usage_models": lambda s, d: _rounded(usage.top_models(usage.usage_by(records(s, d), "model")), "credits"),
    "q_project_rollup": lambda s, d: _rounded(
        usage.project_rollup(records(s, d).withColumn("nano", F.when(C("project") != "/p/3", F.coalesce("nano", F.lit(0))))),
        "credits",
    ),
    "q_project_month": lambda s, d: usage.projects_in_period(records(s, d), "month", AS_OF).drop("calls"),
    "q_project_last_week": lambda s, d: usage.projects_in_period(records(s, d), "lastWeek", AS_OF).drop("calls"),
    "q_model_call_timing": lambda s, d: _rounded(
        usage.model_call_timing(records(s, d)), "duration_ms", "first_token_ms"
    ),
    "q_usage_in_range": lambda s, d: usage.usage_by(
        records(s, d).where(usage.in_range(C("call_date"), "1996-03-01", None)), "model").select("model", "calls"),
    "q_meaningful_threads": _meaningful,
    "q_attach_once": _attached,
    "q_usage_checkpoint": lambda s, d: usage.model_totals(usage_events(s, d), STEPS),
    "q_checkpoint_credits": lambda s, d: usage.session_credits(usage_events(s, d), STEPS),
    "q_unattributed": _unattributed,
    "q_prompt_response": lambda s, d: messages.prompt_outcomes(chat_messages(s, d)),
    "q_prompt_buckets": lambda s, d: messages.prompt_buckets(messages.prompt_outcomes(chat_messages(s, d))),
    "q_turn_usage": lambda s, d: messages.turn_usage(chat_messages(s, d)),
    "q_cli_steps": lambda s, d: messages.cli_steps(messages.turn_usage(chat_messages(s, d))),
    "q_cli_titles": _titles,
    "q_daily_prompts": _daily_prompts,
    "q_tool_exec": lambda s, d: _rounded(
        messages.tool_totals(messages.tool_executions(view(s, d, "calls"))), "success_rate"
    ),
    "q_tool_models": lambda s, d: messages.tool_models(messages.tool_executions(view(s, d, "calls"))),
    "q_model_in_force": lambda s, d: messages.model_in_force(view(s, d, "models"), "default").groupBy("model").agg(
        F.count(F.lit(1)).alias("n")
    ),
    "q_session_date": lambda s, d: messages.date_in_force(view(s, d, "dated"), "2024-01-31").where(
        C("kind") == "other").groupBy("date").agg(F.count(F.lit(1)).alias("n")),
    "q_subagent_share": lambda s, d: _rounded(messages.agent_types(view(s, d, "agents")), "share"),
    "q_session_counters": lambda s, d: messages.session_counters(view(s, d, "activity")),
    "q_subagents": lambda s, d: runs.subagents(view(s, d, "spans")),
    "q_compactions": lambda s, d: _rounded(runs.compactions(view(s, d, "compactions")), "reduction"),
    "q_steering": lambda s, d: runs.dated_events(view(s, d, "notes"), "2024-01-05", None),
    "q_first_events": lambda s, d: runs.first_events(view(s, d, "ids"), "key"),
    "q_permissions": lambda s, d: _permissions(s, d),
    "q_permission_summary": lambda s, d: runs.permission_summary(_permissions(s, d), []),
    "q_permission_by_project": _by_project,
    "q_permission_kinds": lambda s, d: runs.permission_kinds(_permissions(s, d), "2024-01-03", "2024-01-25"),
    "q_fusion_paths": lambda s, d: runs.run_paths(_runs(s, d)[0], *RUN_RANGE),
    "q_fusion_summary": lambda s, d: runs.run_summary(_runs(s, d)[0], *RUN_RANGE),
    "q_fusion_reconcile": lambda s, d: _runs(s, d)[0].groupBy("reconciliation").agg(F.count(F.lit(1)).alias("n")),
    "q_fusion_roles": lambda s, d: runs.run_roles(_runs(s, d)[1], _runs(s, d)[0], *RUN_RANGE),
}

# --- Checking SQL ----------------------------------------------------------------------------------------------------

_FIRST = (
    "rec AS (SELECT * FROM cu QUALIFY row_number() OVER (PARTITION BY session_id, sequence "
    "ORDER BY ship_ms, tie1, tie2, tie3) = 1)"
)
_SUMS = (
    "count(*) AS calls, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, "
    "CASE WHEN count(*) = count(nano) THEN sum(nano)::BIGINT END AS nano"
)
_WALK = (
    "plain AS (SELECT * FROM cu WHERE NOT is_checkpoint QUALIFY row_number() OVER (PARTITION BY session_id, sequence "
    "ORDER BY ship_ms, tie1, tie2, tie3) = 1), "
    "ev AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ship_ms, tie1, tie2, tie3) AS rn, "
    "CAST(right(model, 1) AS INT) + 1 AS m FROM (SELECT * FROM plain UNION ALL SELECT * FROM cu WHERE is_checkpoint) u), "
    "start AS (SELECT DISTINCT session_id, 0 AS rn, [0, 0, 0, 0, 0]::BIGINT[] AS ti, [0, 0, 0, 0, 0]::BIGINT[] AS tou, "
    "[0, 0, 0, 0, 0]::BIGINT[] AS tn, [false, false, false, false, false] AS seen, 0::BIGINT AS total, (-1)::BIGINT AS mark "
    "FROM ev), "
    "walk AS (SELECT * FROM start UNION ALL SELECT session_id, rn, "
    "list_transform(ti, lambda v, i: CASE WHEN i <> m OR skip THEN v WHEN ck THEN inp ELSE v + inp END), "
    "list_transform(tou, lambda v, i: CASE WHEN i <> m OR skip OR (ck AND sequence <> 3) THEN v WHEN ck THEN outp "
    "ELSE v + outp END), "
    "list_transform(tn, lambda v, i: CASE WHEN i <> m OR skip THEN v WHEN ck THEN nano ELSE v + nano END), "
    "list_transform(seen, lambda v, i: v OR (i = m AND NOT skip)), "
    "CASE WHEN skip THEN total WHEN NOT ck THEN total + nano WHEN tie1 % 11 = 0 THEN NULL "
    "WHEN sequence = 3 AND nano IS NOT NULL THEN nano * 2 ELSE total + (nano - tn[m]) END, "
    "CASE WHEN ck THEN sequence ELSE mark END FROM "
    "(SELECT w.session_id, e.rn, w.ti, w.tou, w.tn, w.seen, w.total, w.mark, e.m, e.sequence, e.nano, e.tie1, "
    "e.input_tokens AS inp, e.output_tokens AS outp, e.is_checkpoint AS ck, "
    "NOT e.is_checkpoint AND e.sequence <= w.mark AS skip "
    "FROM walk w JOIN ev e ON e.session_id = w.session_id AND e.rn = w.rn + 1) x), "
    "fin AS (SELECT * FROM walk QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY rn DESC) = 1), "
    "mt AS (SELECT session_id, 'model-' || (i - 1) AS model, ti[i] AS input_tokens, tou[i] AS output_tokens, tn[i] AS nano "
    "FROM (SELECT *, unnest(range(1, 6)) AS i FROM fin) f WHERE seen[i])"
)
_FLAT = "[\\s\\p{{Z}}]+"
_PREVIEW = "left(trim(regexp_replace({0}, '" + _FLAT + "', ' ', 'g')), 160)"
_OPEN = (
    "o AS (SELECT *, row_number() OVER w AS turn, lead(seq) OVER w AS nxt FROM ch WHERE kind IN ('start', 'prompt') "
    "WINDOW w AS (PARTITION BY session_id ORDER BY seq)), "
    "pr AS (SELECT o.session_id, CAST(o.turn AS BIGINT) AS turn, CAST(length(o.content) AS INT) AS chars, "
    "CASE WHEN length(o.content) <= 50 THEN '0-50' WHEN length(o.content) <= 100 THEN '51-100' "
    "WHEN length(o.content) <= 200 THEN '101-200' ELSE '201+' END AS bucket, "
    "EXISTS (SELECT 1 FROM ch r WHERE r.session_id = o.session_id AND r.seq > o.seq AND (o.nxt IS NULL OR r.seq < o.nxt) "
    "AND r.kind = 'reply' AND r.parent_tool_call IS NULL AND (trim(r.content) <> '' "
    "OR (r.output_tokens > 0 AND NOT r.has_tool_requests)) AND CASE WHEN EXISTS (SELECT 1 FROM ch g "
    "WHERE g.session_id = o.session_id AND g.kind = 'agent' AND g.seq > o.seq AND g.seq < r.seq) "
    "THEN coalesce(o.message_id = r.origin_id, false) ELSE o.message_id IS NULL OR r.origin_id IS NULL "
    "OR o.message_id = r.origin_id END) AS answered FROM o WHERE o.kind = 'prompt')"
)
_TURNS = (
    "t AS (SELECT *, sum((kind IN ('prompt', 'agent'))::INT) OVER (PARTITION BY session_id ORDER BY seq) AS turn FROM ch), "
    "tu AS (SELECT session_id, CAST(turn AS BIGINT) AS turn, "
    + _PREVIEW.format("max(content) FILTER (WHERE kind IN ('prompt', 'agent'))")
    + " AS prompt, CASE WHEN bool_or(kind = 'agent') THEN 'ai' ELSE 'human' END AS actor, "
    "CAST(coalesce(sum(usage_tokens), 0) AS BIGINT) AS tokens FROM t WHERE turn > 0 GROUP BY ALL)"
)
_PERMISSIONS = (
    "rq AS (SELECT session_id, request_id, arg_min({'ms': ms, 'pk': permission_kind, 'c': call_id, 'n': tool_name}, seq) AS q, "
    "min(seq) AS qs FROM decisions WHERE kind = 'request' GROUP BY ALL), "
    "rs AS (SELECT session_id, request_id, arg_min({'ms': ms, 'c': call_id, 'd': decision_source, 'r': result}, seq) AS a, "
    "min(seq) AS rs_seq FROM decisions WHERE kind = 'response' GROUP BY ALL), "
    "pn AS (SELECT session_id, call_id, arg_max(tool_name, seq) AS nm FROM names WHERE tool_name IS NOT NULL GROUP BY ALL), "
    "p0 AS (SELECT session_id, request_id, q.pk AS permission_kind, CASE WHEN qs > rs_seq THEN q.c "
    "ELSE coalesce(q.c, a.c) END AS call_id, q.n AS own, q.ms AS requested_ms, a.ms AS responded_ms, "
    "CASE WHEN a.d <> 'other' THEN a.d END AS decision_source, CASE WHEN a.r = 'approved' THEN a.r END AS result, "
    "qs IS NOT NULL AS request_recorded, rs_seq IS NOT NULL AS response_recorded "
    "FROM rq FULL OUTER JOIN rs USING (session_id, request_id)), "
    "pm AS (SELECT p0.* EXCLUDE (own), coalesce(own, nm) AS tool_name FROM p0 LEFT JOIN pn USING (session_id, call_id))"
)


def _inside(column: str, start: str, end: str) -> str:
    return f"coalesce(strftime(make_timestamp({column} * 1000), '%Y-%m-%d') BETWEEN '{start}' AND '{end}', false)"


def _summary(keys: str, start: str, end: str) -> str:
    head, group = (f"{keys}, ", f" GROUP BY {keys}") if keys else ("", "")
    human = f"response_recorded AND decision_source = 'human_response' AND {_inside('responded_ms', start, end)}"
    policy = f"response_recorded AND decision_source = 'host_policy' AND {_inside('responded_ms', start, end)}"
    seen = f"({_inside('requested_ms', start, end)} OR {_inside('responded_ms', start, end)})"
    wait = f"CASE WHEN {human} AND responded_ms >= requested_ms THEN responded_ms - requested_ms END"
    return (
        f"SELECT {head}count(*) FILTER (WHERE {human}) AS human, count(*) FILTER (WHERE {policy}) AS host_policy, "
        f"count(DISTINCT session_id) FILTER (WHERE {seen}) AS observed_sessions, "
        f"count(DISTINCT session_id) FILTER (WHERE {human}) AS human_sessions, median({wait}) AS median_ms, "
        f"count({wait}) AS median_ms_samples FROM pq{group}"
    )


_RUNS = (
    "ct AS (SELECT run_id, "
    + ", ".join(
        f"CASE run_id % 10 WHEN 0 THEN sum({f}) - 1 WHEN 1 THEN NULL ELSE sum({f}) END AS c_{f}, "
        f"CASE WHEN count(*) = count({f}) THEN sum({f}) END AS s_{f}"
        for f in runs.RUN_FIELDS
    )
    + " FROM fr GROUP BY run_id), "
    "st AS (SELECT run_id, min(ms) AS ms FROM fr0 GROUP BY run_id), "
    "pa AS (SELECT run_id, string_agg(kind, ' → ' ORDER BY time, seq) AS path, bool_or(kind = 'judge') AS j, "
    "bool_or(kind = 'judge') AND bool_or(kind = 'repair') AS rp FROM fr GROUP BY run_id), "
    "rr AS (SELECT *, CASE WHEN run_id % 5 = 3 THEN 'unavailable' WHEN "
    + " OR ".join(f"coalesce(c_{f} <> s_{f}, false)" for f in runs.RUN_FIELDS)
    + " THEN 'mismatch' WHEN "
    + " OR ".join(f"c_{f} IS NULL OR s_{f} IS NULL" for f in runs.RUN_FIELDS)
    + " THEN 'unavailable' ELSE 'match' END AS reconciliation FROM ct JOIN st USING (run_id) JOIN pa USING (run_id))"
)
_VISIBLE = _inside("ms", *RUN_RANGE)


def _cu(*parts: str) -> str:
    return f"WITH RECURSIVE {', '.join([CU_SQL, _FIRST, *parts[:-1]])} {parts[-1]}"


def _ch(*parts: str) -> str:
    return f"WITH {', '.join([CH_SQL, *parts[:-1]])} {parts[-1]}"


def _ev(names: list[str], *parts: str) -> str:
    return f"WITH {', '.join([RAW_SQL, *[_view_sql(n) for n in names], *parts[:-1]])} {parts[-1]}"


def _fr(*parts: str) -> str:
    return f"WITH {', '.join([_FR_SQL, *parts[:-1]])} {parts[-1]}"


_PERIOD = "SELECT project, " + _SUMS.split(", ", 1)[1] + " FROM rec WHERE call_date BETWEEN '{0}' AND '{1}' GROUP BY project"
_SHARE = (
    "CASE WHEN p > 0 AND p < 0.01 THEN '<0.01%' ELSE rtrim(rtrim(printf('%.2f', round(p, 2)), '0'), '.') || '%' END"
)
_TOOLS = (
    "ex AS (SELECT c.*, coalesce(c.name, (SELECT arg_max(s.name, s.seq) FROM calls s WHERE s.session_id = c.session_id "
    "AND s.call_id = c.call_id AND s.kind = 'start' AND s.seq < c.seq)) AS tool FROM calls c WHERE c.kind = 'complete'), "
    "te AS (SELECT * FROM ex WHERE tool IS NOT NULL AND success IS NOT NULL)"
)

ORACLES = {
    "q_usage_dedup": _cu("SELECT session_id, sequence, call_date, model, input_tokens, nano FROM rec"),
    "q_usage_by_model": _cu(f"SELECT model, {_SUMS} FROM rec GROUP BY model"),
    "q_usage_by_day": _cu(f"SELECT call_date, {_SUMS} FROM rec GROUP BY call_date"),
    "q_usage_by_thread": _cu(f"SELECT session_id, project, {_SUMS} FROM rec GROUP BY session_id, project"),
    "q_usage_by_project_day": _cu(f"SELECT project, call_date, {_SUMS} FROM rec GROUP BY project, call_date"),
    "q_top_usage_models": _cu(
        f"s AS (SELECT model, {_SUMS} FROM rec GROUP BY model)",
        "SELECT model, input_tokens + output_tokens AS total_tokens, round(nano / 1e9, 4) AS credits FROM s "
        "ORDER BY nano DESC NULLS LAST, input_tokens + output_tokens DESC, model LIMIT 5",
    ),
    "q_project_rollup": _cu(
        "z AS (SELECT project, input_tokens, output_tokens, CASE WHEN project <> '/p/3' THEN coalesce(nano, 0) END AS nano "
        "FROM rec)",
        f"s AS (SELECT project, grouping(project) = 1 AS is_total, {_SUMS} FROM z GROUP BY ROLLUP (project))",
        "q AS (SELECT *, (input_tokens + output_tokens) / (SELECT sum(input_tokens + output_tokens) FROM z) * 100 AS p FROM s)",
        "SELECT CASE WHEN is_total THEN 'All projects' WHEN project IS NULL THEN 'Unknown' "
        f"ELSE regexp_extract(project, '[^/]+$') END AS name, project, is_total, input_tokens, output_tokens, "
        f"round(nano / 1e9, 4) AS credits, {_SHARE} AS share FROM q",
    ),
    "q_project_month": _cu(_PERIOD.format("1998-06-01", "1998-06-15")),
    "q_project_last_week": _cu(_PERIOD.format("1998-06-08", "1998-06-14")),
    "q_model_call_timing": _cu(
        "SELECT model, round(avg(duration_ms), 4) AS duration_ms, count(duration_ms) AS duration_samples, "
        "round(avg(first_token_ms), 4) AS first_token_ms, count(first_token_ms) AS first_token_samples FROM rec GROUP BY model"
    ),
    "q_usage_in_range": _cu("SELECT model, count(*) AS calls FROM rec WHERE call_date >= '1996-03-01' GROUP BY model"),
    "q_meaningful_threads": _ch(
        "s AS (SELECT session_id, conv_id, seq, count(*) FILTER (WHERE kind IN ('prompt', 'agent')) AS prompts, "
        "CAST(coalesce(sum(usage_tokens), 0) AS BIGINT) AS tokens FROM ch GROUP BY ALL)",
        "SELECT session_id, seq, prompts, tokens, CASE WHEN conv_id % 4 <> 0 THEN conv_id % 4 - 1 END AS nano FROM s "
        "WHERE prompts > 0 OR tokens > 0 OR conv_id % 4 IN (0, 2, 3) OR conv_id % 6 = 1 OR conv_id % 10 = 1",
    ),
    "q_attach_once": (
        f"WITH {RAW_SQL}, t AS (SELECT 'g' || (user_id % 10) AS session_id, event_id AS position FROM raw WHERE et = 'error') "
        "SELECT session_id, position, CASE WHEN row_number() OVER (PARTITION BY session_id ORDER BY position) = 1 "
        "THEN count(*) OVER (PARTITION BY session_id) END AS details FROM t"
    ),
    "q_usage_checkpoint": _cu(_WALK, "SELECT * FROM mt"),
    "q_checkpoint_credits": _cu(_WALK, "SELECT session_id, total AS nano FROM fin"),
    "q_unattributed": _cu(
        _WALK,
        "SELECT basis, CAST((SELECT sum(input_tokens + output_tokens) FROM mt) - (SELECT sum(input_tokens + output_tokens) "
        "FROM plain) AS BIGINT) AS unattributed_tokens, CASE WHEN basis = 'filled' OR ((SELECT count(*) = count(nano) FROM mt) "
        "AND (SELECT count(*) = count(nano) FROM plain)) THEN round(((SELECT sum(coalesce(nano, 0)) FROM mt) - "
        "(SELECT sum(coalesce(nano, 0)) FROM plain)) / 1e9, 4) END AS unattributed_credits "
        "FROM (VALUES ('recorded'), ('filled')) AS b (basis)",
    ),
    "q_prompt_response": _ch(_OPEN, "SELECT * FROM pr"),
    "q_prompt_buckets": _ch(
        _OPEN,
        "SELECT bucket, shown, answered, CAST(CASE bucket WHEN '0-50' THEN 25 WHEN '51-100' THEN 75 WHEN '101-200' THEN 150 "
        "ELSE 300 END AS INT) AS x, floor(answered / shown * 1000 + 0.5) / 10 AS y, "
        "CAST(greatest(4, floor(sqrt(shown) * 3 + 0.5)) AS INT) AS r FROM (SELECT bucket, count(*) AS shown, "
        "count(*) FILTER (WHERE answered) AS answered FROM pr GROUP BY bucket) b",
    ),
    "q_turn_usage": _ch(_TURNS, "SELECT * FROM tu"),
    "q_cli_steps": _ch(
        _TURNS,
        "SELECT 'cli:' || session_id AS session_id, turn, actor, CASE WHEN actor = 'ai' THEN 'execution' ELSE 'human' END "
        "AS phase, 'Prompt' AS label, CASE WHEN prompt = '' THEN '(No prompt preview)' ELSE prompt END AS detail, tokens FROM tu",
    ),
    "q_cli_titles": _ch(
        "SELECT session_id, coalesce(arg_max(left(CASE WHEN title_kind = 'start' THEN title_content ELSE "
        "regexp_replace(title_content, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') END, 160), seq) FILTER (WHERE title_kind IN "
        "('start', 'title') AND title_content IS NOT NULL), arg_min("
        + _PREVIEW.format("title_content")
        + ", seq) FILTER (WHERE title_kind = 'prompt'), 'CLI session ' || left(session_id, 8)) AS title FROM ch GROUP BY session_id"
    ),
    "q_daily_prompts": _duck(
        f"WITH {CU_SQL}, {_FIRST}, {CH_SQL}, "
        "a AS (SELECT session_id, date, count(*) FILTER (WHERE kind = 'prompt') AS prompts, sum(output_tokens) AS legacy "
        "FROM ch WHERE kind IN ('prompt', 'reply') GROUP BY ALL), "
        f"b AS (SELECT concat('c', session_id) AS session_id, {_DAY.format('CAST(session_id AS BIGINT)')} AS date, "
        "sum(output_tokens) AS used FROM rec GROUP BY ALL) "
        "SELECT date, CAST(coalesce(sum(prompts), 0) AS BIGINT) AS prompts, "
        "CAST(sum(coalesce(used, legacy, 0)) AS BIGINT) AS output_tokens FROM a FULL OUTER JOIN b USING (session_id, date) "
        "GROUP BY date"
    ),
    "q_tool_exec": _ev(
        ["calls"], _TOOLS,
        "SELECT tool, count(*) AS total, count(*) FILTER (WHERE success) AS succeeded, "
        "count(*) FILTER (WHERE NOT success) AS failed, round(count(*) FILTER (WHERE success) / count(*) * 100, 4) "
        "AS success_rate FROM te GROUP BY tool",
    ),
    "q_tool_models": _ev(["calls"], _TOOLS, "SELECT tool, model, count(*) AS n FROM te GROUP BY tool, model"),
    "q_model_in_force": _ev(
        ["models"],
        "f AS (SELECT *, last_value(CASE WHEN kind = 'start' THEN coalesce(model, 'default') WHEN kind = 'change' THEN model END "
        "IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) "
        "AS cur FROM models)",
        "SELECT coalesce(model, cur, 'default') AS model, count(*) AS n FROM f WHERE kind = 'message' GROUP BY 1",
    ),
    "q_session_date": _ev(
        ["dated"],
        "SELECT coalesce(date, (SELECT arg_max(s.date, s.seq) FROM dated s WHERE s.session_id = d.session_id "
        "AND s.kind = 'start' AND s.seq < d.seq), '2024-01-31') AS date, count(*) AS n FROM dated d WHERE kind = 'other' "
        "GROUP BY 1",
    ),
    "q_subagent_share": _ev(
        ["agents"],
        "SELECT agent_name, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 4) AS share FROM agents GROUP BY 1",
    ),
    "q_session_counters": _ev(
        ["activity"],
        "SELECT session_id, count(*) FILTER (WHERE kind = 'message') AS interactions, count(*) FILTER (WHERE kind = 'turn') "
        "AS turns, count(*) FILTER (WHERE kind = 'change') AS model_changes, min(time) AS started_ms, "
        "max(time) AS last_activity_ms FROM activity GROUP BY session_id",
    ),
    "q_subagents": _ev(
        ["spans"],
        "f AS (SELECT session_id, call_id, min(seq) AS s FROM spans WHERE kind = 'started' GROUP BY ALL), "
        "e AS (SELECT f.session_id, f.call_id, f.s, arg_max(c.duration_ms, c.seq) AS dur FROM f JOIN spans c "
        "ON c.session_id = f.session_id AND c.call_id = f.call_id AND c.seq > f.s AND c.kind = 'completed' "
        "AND c.duration_ms >= 0 GROUP BY ALL)",
        "SELECT x.session_id, x.call_id, x.seq, coalesce(x.agent_name, 'Unknown') AS agent_name, x.parent_id, x.model, "
        "e.dur AS duration_ms FROM spans x LEFT JOIN e ON e.session_id = x.session_id AND e.call_id = x.call_id AND e.s = x.seq "
        "WHERE x.kind = 'started' AND x.call_id IS NOT NULL",
    ),
    "q_compactions": _ev(
        ["compactions"],
        "SELECT session_id, seq, trigger, success, CASE WHEN before_tokens >= 0 THEN before_tokens END AS before_tokens, "
        "after_tokens, CASE WHEN before_tokens > 0 THEN round(1 - after_tokens / before_tokens, 4) END AS reduction "
        "FROM compactions",
    ),
    "q_steering": _ev(
        ["notes"],
        "SELECT kind, count(*) AS n FROM notes WHERE strftime(make_timestamp(ms * 1000), '%Y-%m-%d') >= '2024-01-05' GROUP BY kind",
    ),
    "q_first_events": _ev(
        ["ids"],
        "SELECT * FROM ids WHERE key IS NULL UNION ALL (SELECT * FROM ids WHERE key IS NOT NULL "
        "QUALIFY row_number() OVER (PARTITION BY key ORDER BY time, seq) = 1)",
    ),
    "q_permissions": _ev(["decisions", "names"], _PERMISSIONS, "SELECT * FROM pm"),
    "q_permission_summary": _ev(
        ["decisions", "names"], _PERMISSIONS, "pq AS (SELECT * FROM pm)", _summary("", "0000-00-00", "9999-99-99")
    ),
    "q_permission_by_project": _ev(
        ["decisions", "names"], _PERMISSIONS, "pq AS (SELECT *, right(session_id, 1) AS project FROM pm)",
        _summary("project", "2024-01-03", "2024-01-25"),
    ),
    "q_permission_kinds": _ev(
        ["decisions", "names"], _PERMISSIONS,
        "SELECT coalesce(permission_kind, 'Unknown') AS permission_kind, count(*) AS n FROM pm WHERE response_recorded AND "
        f"decision_source = 'human_response' AND {_inside('responded_ms', '2024-01-03', '2024-01-25')} GROUP BY 1",
    ),
    "q_fusion_paths": _fr(_RUNS, f"SELECT path, count(*) AS n FROM rr WHERE {_VISIBLE} GROUP BY path"),
    "q_fusion_summary": _fr(
        _RUNS,
        f"SELECT count(*) FILTER (WHERE {_VISIBLE}) AS runs, count(*) FILTER (WHERE {_VISIBLE} AND j) AS judged, "
        f"count(*) FILTER (WHERE {_VISIBLE} AND rp) AS repaired, count(*) FILTER (WHERE ms IS NULL) AS undated FROM rr",
    ),
    "q_fusion_reconcile": _fr(_RUNS, "SELECT reconciliation, count(*) AS n FROM rr GROUP BY 1"),
    "q_fusion_roles": _fr(
        _RUNS,
        "SELECT kind, CASE WHEN count(*) = count(nano) THEN CAST(sum(nano) AS BIGINT) END AS nano, count(*) AS phases FROM fr "
        f"WHERE run_id IN (SELECT run_id FROM rr WHERE {_VISIBLE}) GROUP BY kind",
    ),
}
