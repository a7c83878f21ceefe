"""Queries over saved chats: tool calls, steps, trees, keywords, title matching and unions with other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import settings
from ..functions import keywords
from ..operators import chats, events, logstats, matching, sessions, usage
from ..operators import loglines
from .adapters import PAUSE_MS, RAW_SQL, TE_SQL, _duck, spread, table, tracked_events
from .logs_catalog import _LL, _DAILY, _LX, extra_lines, facts
from .sessions_catalog import _FLAGS, _SEGMENTS, _SUMMARY, _THREADS, _rows, _session_list, _thread_rows
from .usage_catalog import _FIRST, CU_SQL, records

C = F.col
AS_OF_MS = 1_706_659_200_000

# --- Adapters --------------------------------------------------------------------------------------------------------

_CREATED = f"CAST({AS_OF_MS} - conv_id * 3600000 AS BIGINT)"
_FIRST_TEXT = (
    "CASE conv_id % 3 WHEN 0 THEN concat('signup ', CAST(conv_id * 6 % 100 AS STRING)) WHEN 1 THEN 'Signup' ELSE text END"
)
CHAT_COLUMNS = {"chat_id": "conv_id", "created_ms": _CREATED, "first_text": _FIRST_TEXT}
REQUEST_COLUMNS = {
    "chat_id": "conv_id",
    "request_no": "turn",
    "ms": f"CASE WHEN conv_id % 7 = 0 THEN CAST(0 AS BIGINT) ELSE {_CREATED} + turn * 60000 END",
    "agent_id": "CASE WHEN conv_id % 4 = 0 THEN '' ELSE concat('agent-', CAST(conv_id % 4 AS STRING)) END",
    "agent_name": "CASE WHEN conv_id % 5 = 0 THEN 'helper' END",
    "model_id": "CASE WHEN conv_id % 3 = 2 THEN '' ELSE concat('model-', CAST(conv_id % 3 AS STRING)) END",
    "text": "CASE WHEN conv_id % 10 = 9 THEN ' ' ELSE text END",
}
_CALL_NAME = (
    "CASE (conv_id + i) % 6 WHEN 0 THEN 'apply_patch' WHEN 1 THEN 'runInTerminal' WHEN 2 THEN 'grep_search' "
    "WHEN 3 THEN 'compact_memory' WHEN 4 THEN 'runSubagent' ELSE 'tool/think_hard' END"
)
CALL_COLUMNS = {
    "chat_id": "conv_id", "request_no": "turn", "pos": "CAST(i AS BIGINT)",
    "call_id": "concat('t', CAST(i AS STRING))", "name": _CALL_NAME,
}
INVOCATION_COLUMNS = {
    "chat_id": "conv_id", "request_no": "turn", "pos": "CAST(i AS BIGINT)",
    "call_id": "CASE i WHEN 0 THEN 's0' WHEN 1 THEN 'x1' WHEN 2 THEN 's0' ELSE 'x3' END",
    "tool_id": "CASE i WHEN 1 THEN 'grep_search' WHEN 3 THEN 'runInTerminal' ELSE 'runSubagent' END",
    "parent_id": "CASE WHEN i = 1 THEN 's0' END",
    "is_subagent": "i IN (0, 2)",
    "description": "CASE i WHEN 0 THEN 'sub zero' WHEN 2 THEN 'dup' END",
    "mcp_server": "CASE i WHEN 1 THEN 'srv-a' WHEN 3 THEN 'srv-b' END",
}


def _exprs(columns):
    return [f"{v} AS {k}" for k, v in columns.items()]


def _user_turns(spark, sf):
    return table(spark, sf, "conversations").where(C("role") == "user")


def _first_turns(spark, sf):
    first = F.min_by(F.struct("text"), "turn").alias("f")
    turns = _user_turns(spark, sf).groupBy("conv_id").agg(first, F.max("turn").alias("turns"))
    return turns.select("conv_id", "turns", "f.text")


def saved_chats(spark, sf):
    rows = _first_turns(spark, sf).selectExpr(*_exprs(CHAT_COLUMNS), "turns")
    return rows.select(
        "chat_id", "created_ms", "first_text", chats.text.truncate_title(C("first_text")).alias("title"),
        (C("created_ms") + C("turns") * 60_000).alias("last_ms"),
    )


def requests(spark, sf):
    return _user_turns(spark, sf).selectExpr(*_exprs(REQUEST_COLUMNS))


def _spread(spark, sf, count):
    """User turns with one row per index below `count`."""
    turns = _user_turns(spark, sf).withColumn("n", count)
    return turns.where(C("n") > 0).select("conv_id", "turn", F.explode(F.sequence(F.lit(0), (C("n") - 1).cast("int"))).alias("i"))


def calls(spark, sf):
    plain = _spread(spark, sf, (C("conv_id") + C("turn")) % 4).selectExpr(*_exprs(CALL_COLUMNS))
    results = plain.where(C("pos") % 2 == 0).select(
        "chat_id", "request_no", "call_id", F.concat(F.lit("args "), C("pos").cast("string")).alias("args")
    )
    inner = _spread(spark, sf, F.when((C("conv_id") + C("turn")) % 4 == 3, 4).otherwise(0))
    return chats.tool_calls(plain, results, inner.selectExpr(*_exprs(INVOCATION_COLUMNS)))


def _steps(spark, sf, saved=None):
    saved = saved_chats(spark, sf) if saved is None else saved
    return chats.chat_steps(saved, requests(spark, sf), calls(spark, sf), 120_000)


def _threads(rows):
    return sessions.threads(rows).withColumn("saw_title_request", C("thread_no") % 3 == 0)


def _match(spark, sf, rows=None, saved=None):
    """`rows` and `saved`: events with their threads and saved chats, where the caller has them stored."""
    rows = _thread_rows(spark, sf) if rows is None else rows
    saved = settings.stored(saved_chats(spark, sf)) if saved is None else saved
    return matching.match_titles(_threads(rows), saved.where(C("chat_id") % 2 == 0), saved)


def _thread_steps(spark, sf):
    rows, saved = _thread_rows(spark, sf).stored(), settings.stored(saved_chats(spark, sf))
    own = sessions.thread_steps(rows, PAUSE_MS)
    return chats.steps_for_threads(_match(spark, sf, rows, saved), own, _steps(spark, sf, saved))


def chat_catalog(spark, sf):
    """Regions, nations and customers as a three-level chat catalog; region 0 hangs under one of its own nations."""
    json = lambda path, value: F.concat(F.lit('{"' + path + '":"'), value, F.lit('"}'))
    none = F.lit(None).cast("string")
    summary = lambda name: F.concat(F.lit('{"data":{"summary":"  '), name, F.lit(' "}}'))
    region = table(spark, sf, "region").select(
        F.concat(F.lit("r"), "r_regionkey").alias("chat_uri"),
        F.when(C("r_regionkey") == 0, "n0").alias("parent_chat"),
        json("sdkSessionId", F.concat(F.lit("s"), "r_regionkey")).alias("provider_data"),
        summary(C("r_name")).alias("metadata"), json("kind", F.lit("user")).alias("origin"), F.lit(0).alias("tombstoned"),
    )
    nation = table(spark, sf, "nation").select(
        F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), none, summary(C("n_name")),
        json("kind", F.lit("tool")), F.lit(0),
    )
    customer = table(spark, sf, "customer").select(
        F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey"), none, F.lit("{broken"),
        json("kind", F.lit("other")), (C("c_custkey") % 10 == 0).cast("int"),
    )
    return region.union(nation).union(customer)


def _tree(spark, sf):
    return chats.chat_tree(chats.live_catalog(chat_catalog(spark, sf)))


def _versions(spark, sf):
    """Three stored versions of every chat, some without a title or a last message."""
    base = saved_chats(spark, sf)
    return base.select("chat_id", "title", "last_ms", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("load_no")).select(
        "chat_id", "load_no",
        F.when((C("chat_id") + C("load_no")) % 3 != 0, F.concat("title", F.lit(" v"), "load_no")).alias("title"),
        F.when((C("chat_id") + C("load_no")) % 4 != 1, C("last_ms") + (C("chat_id") * C("load_no")) % 5 * 1000).alias("last_ms"),
    )


def _union_sessions(spark, sf):
    editor = _session_list(spark, sf).select("session_id", "title", "date", "total_actions")
    cli = records(spark, sf).groupBy("session_id").agg(F.min("call_date").alias("date"), F.count(F.lit(1)).alias("n"))
    named = cli.select(
        F.concat(F.lit("cli:"), "session_id").alias("session_id"), F.concat(F.lit("order "), "session_id").alias("title"),
        "date", C("n").alias("total_actions"),
    )
    return editor.unionByName(named)


def _date_spine(spark, sf):
    cli = records(spark, sf).groupBy(C("call_date").alias("date")).agg(F.count(F.lit(1)).alias("cli_calls"))
    return date_spine(logstats.daily(facts(spark, sf)), cli)


def date_spine(days, cli):
    """One row per date known to the editor logs or the CLI, with 0 where one of them has nothing (one shuffle)."""
    both = days.unionByName(cli, allowMissingColumns=True)
    counters = [c for c in both.columns if c != "date"]
    return both.groupBy("date").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters])


def _signal_union(spark, sf):
    lines = extra_lines(spark, sf)
    derived = loglines.signal_events(lines, loglines.log_facts(lines))
    stored = tracked_events(spark, sf)
    merged = stored.unionByName(derived, allowMissingColumns=True)
    return merged.groupBy("event_type", "signal_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("ms").alias("first_ms"), F.max("ms").alias("last_ms")
    )


QUERIES = {
    "q_tool_calls": lambda s, d: calls(s, d),
    "q_chat_steps": _steps,
    "q_turn_histogram": lambda s, d: chats.turn_histogram(requests(s, d)),
    "q_keywords": lambda s, d: chats.top_keywords(spread(table(s, d, "documents").select("text")), "text"),
    "q_prompt_keywords": lambda s, d: chats.top_keywords(_user_turns(s, d), "text"),
    "q_chat_latest": lambda s, d: chats.latest_chats(_versions(s, d)),
    "q_chat_titles_merged": lambda s, d: chats.merged_titles(_versions(s, d)),
    "q_chat_tree": lambda s, d: _tree(s, d).withColumn("path", F.array_join("path", ">")),
    "q_catalog_attach": lambda s, d: chats.with_children(
        table(s, d, "region").select(F.concat(F.lit("s"), "r_regionkey").alias("session_id"), "r_name"), _tree(s, d)
    ),
    "q_title_match_nearest": lambda s, d: matching.nearest_chats(_threads(_thread_rows(s, d)), saved_chats(s, d)),
    "q_title_match_exclusive": lambda s, d: _match(s, d).select("session_id", "thread_no", "chat_id", "matched_title"),
    "q_matched_thread_titles": lambda s, d: sessions.with_titles(_match(s, d)).select("session_id", "thread_no", "title"),
    "q_thread_chat_steps": _thread_steps,
    "q_union_sessions": _union_sessions,
    "q_date_spine": _date_spine,
    "q_signal_union": _signal_union,
}

# --- Checking SQL ----------------------------------------------------------------------------------------------------

_CHATS = _duck(
    "us AS (SELECT * FROM conversations WHERE role = 'user'), "
    "ft AS (SELECT conv_id, arg_min(text, turn) AS text, max(turn) AS turns FROM us GROUP BY conv_id), "
    f"sc0 AS (SELECT {', '.join(_exprs(CHAT_COLUMNS))}, turns FROM ft), "
    "sc AS (SELECT chat_id, created_ms, first_text, CASE WHEN length(first_text) > 80 THEN left(first_text, 80) || '…' "
    "ELSE first_text END AS title, created_ms + turns * 60000 AS last_ms FROM sc0), "
    f"rq AS (SELECT {', '.join(_exprs(REQUEST_COLUMNS))} FROM us)"
)
_CALLS = _duck(
    f"pc AS (SELECT {', '.join(_exprs(CALL_COLUMNS))}, (conv_id + turn) % 4 AS n FROM "
    "(SELECT *, unnest(range((conv_id + turn) % 4)) AS i FROM us) x), "
    "ins AS (SELECT chat_id, request_no, coalesce(min(pos) FILTER (WHERE name = 'runSubagent'), 1099511627776) AS slot "
    "FROM pc WHERE n = 3 GROUP BY ALL), "
    "tc AS (SELECT c.*, m.srv AS mcp_server FROM ("
    "SELECT chat_id, request_no, pos AS slot, (-1)::BIGINT AS sub_no, (-1)::BIGINT AS child_no, call_id, name, "
    "CASE WHEN pos % 2 = 0 THEN 'args ' || pos END AS args, NULL AS description, NULL AS parent_id, n FROM pc "
    "WHERE n < 3 OR name <> 'runSubagent' UNION ALL "
    "SELECT chat_id, request_no, slot, 0, -1, 's0', 'runSubagent', NULL, 'sub zero', NULL, 3 FROM ins UNION ALL "
    "SELECT chat_id, request_no, slot, 0, 1, 'x1', 'grep_search', NULL, NULL, 's0', 3 FROM ins) c "
    "LEFT JOIN (VALUES ('grep_search', 'srv-a'), ('runInTerminal', 'srv-b')) m(tool, srv) ON c.n = 3 AND c.name = m.tool)"
)
_STEPS = (
    "cn AS (SELECT *, row_number() OVER (PARTITION BY chat_id, request_no ORDER BY slot, sub_no, child_no) AS call_no, "
    "count(*) OVER (PARTITION BY chat_id, request_no) AS cnt FROM tc), "
    "bs AS (SELECT rq.*, CASE WHEN ms > 0 THEN ms ELSE created_ms END AS base_ms, coalesce(cnt, 0) AS calls FROM rq "
    "JOIN sc USING (chat_id) LEFT JOIN (SELECT DISTINCT chat_id, request_no, cnt FROM cn) q USING (chat_id, request_no)), "
    "sh AS (SELECT *, trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM bs), "
    "raw_steps AS ("
    "SELECT chat_id, request_no, ms AS rms, 0::BIGINT AS part, base_ms AS step_ms, 'human' AS actor, 'human' AS phase, "
    "'Prompt' AS label, CASE WHEN length(t) > 96 THEN rtrim(left(t, 95)) || '…' ELSE t END AS detail, "
    "'chat/request' AS intent, false AS is_fallback FROM sh WHERE t <> '' UNION ALL "
    "SELECT chat_id, request_no, ms, 1, base_ms + 1, 'ai', CASE WHEN calls > 0 THEN 'planning' ELSE 'execution' END, "
    "'Thought', coalesce(agent_name, CASE WHEN calls = 1 THEN '1 tool call' WHEN calls > 1 THEN calls || ' tool calls' "
    "WHEN model_id = '' THEN 'Assistant response' ELSE model_id END), "
    "CASE WHEN agent_id = '' THEN 'chat/response' ELSE agent_id END, true FROM sh UNION ALL "
    "SELECT chat_id, request_no, ms, call_no + 1, base_ms + call_no + 1, CASE WHEN name = 'compact_memory' THEN 'system' "
    "ELSE 'ai' END, CASE name WHEN 'grep_search' THEN 'research' WHEN 'compact_memory' THEN 'memory' ELSE 'execution' END, "
    "CASE name WHEN 'apply_patch' THEN 'Updated' WHEN 'runInTerminal' THEN 'Executed' WHEN 'grep_search' THEN 'Searched' "
    "WHEN 'compact_memory' THEN 'Memory file' ELSE 'Thought' END, coalesce(description, mcp_server, args, "
    "CASE name WHEN 'apply_patch' THEN 'apply patch' WHEN 'grep_search' THEN 'grep search' WHEN 'compact_memory' "
    "THEN 'compact memory' WHEN 'tool/think_hard' THEN 'think hard' ELSE name END), name, "
    "name IN ('runSubagent', 'tool/think_hard') FROM cn JOIN bs USING (chat_id, request_no)), "
    "cs AS (SELECT * EXCLUDE (rms), lead(step_ms) OVER (PARTITION BY chat_id ORDER BY step_ms, rms, request_no, part) "
    "- step_ms AS duration_ms FROM raw_steps)"
)
_BOUND = (
    "tp AS (SELECT *, thread_no % 3 = 0 AS wide, lower(coalesce(first_prompt, '')) AS p FROM full_threads), "
    "cp AS (SELECT *, lower(trim(regexp_replace(first_text, '[\\s\\p{Z}]+', ' ', 'g'))) AS p FROM sc)"
)


_SCORED = (
    "{name} AS (SELECT t.session_id, t.thread_no, {list_no} AS list_no, c.chat_id, c.created_ms, "
    "abs(c.created_ms - t.started_ms) - CASE WHEN t.p = '' OR c.p = '' THEN 0 WHEN t.p = c.p THEN 600000 "
    "WHEN contains(t.p, c.p) OR contains(c.p, t.p) THEN 300000 ELSE 0 END AS score FROM tp t JOIN cp c "
    "ON abs(c.created_ms - t.started_ms) <= CASE WHEN t.wide THEN 7200000 ELSE 1800000 END WHERE {where})"
)
_MATCH = ", ".join([
    _BOUND,
    _SCORED.format(name="l0", list_no=0, where="c.chat_id % 2 = 0"),
    _SCORED.format(name="l1", list_no=1, where="true"),
    "wish AS (SELECT session_id, thread_no, list({'l': list_no, 'id': chat_id, 's': score} "
    "ORDER BY list_no, score, created_ms, chat_id) AS w FROM (SELECT * FROM l0 UNION ALL SELECT * FROM l1) u GROUP BY ALL), "
    "ordered AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY thread_no) AS rn FROM wish), "
    "pick AS (SELECT session_id, 0::BIGINT AS rn, 0::BIGINT AS thread_no, []::BIGINT[] AS used, NULL::BIGINT AS chat_id "
    "FROM (SELECT DISTINCT session_id FROM ordered) d UNION ALL "
    "SELECT session_id, rn, thread_no, CASE WHEN id IS NULL THEN used ELSE list_append(used, id) END, id FROM "
    "(SELECT o.session_id, o.rn, o.thread_no, p.used, "
    "list_filter(o.w, lambda x: NOT list_contains(p.used, x.id))[1].id AS id FROM pick p JOIN ordered o "
    "ON o.session_id = p.session_id AND o.rn = p.rn + 1) q), "
    "mm AS (SELECT tp.session_id, tp.thread_no, sc.chat_id, sc.title AS matched_title, tp.title AS own_title FROM tp "
    "LEFT JOIN (SELECT * FROM pick WHERE rn > 0) k USING (session_id, thread_no) LEFT JOIN sc ON sc.chat_id = k.chat_id)",
])


def _words(source: str, where: str = "true") -> str:
    english, japanese = (
        ", ".join("'" + w + "'" for w in words) for words in (keywords.ENGLISH_STOP_WORDS, keywords.JAPANESE_STOP_WORDS)
    )
    separators = (
        r"[\s\p{Z}\x{3000}\x{ff0c}\x{3001}\x{3002}\x{ff01}\x{ff1f}!\"#$%&''()*+,\-./:;<=>?@\[\\\]^_{|}~"
        r"\x{300c}\x{300d}\x{300e}\x{300f}\x{3010}\x{3011}]+"
    )
    return (
        "SELECT lower(w) AS word, count(*) AS n FROM (SELECT trim(unnest(string_split_regex(regexp_replace(text, "
        f"'https?://[^\\s\\p{{Z}}]*', ' ', 'g'), '{separators}')), '`') AS w FROM {source} WHERE {where}) q "
        f"WHERE length(w) >= 2 AND NOT regexp_full_match(w, '[0-9]+') AND lower(w) NOT IN ({english}) "
        f"AND w NOT IN ({japanese}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"
    )


_CATALOG = (
    "cat AS (SELECT 'r' || r_regionkey AS uri, CASE WHEN r_regionkey = 0 THEN 'n0' END AS parent, 's' || r_regionkey AS sid, "
    "r_name AS title, 'user' AS origin FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, NULL, n_name, "
    "'tool' FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, NULL, 'Untitled chat', NULL FROM customer "
    "WHERE c_custkey % 10 <> 0), "
    "tree AS (SELECT sid AS session_id, uri AS root_uri, uri AS chat_uri, [uri] AS path, 0 AS depth, title, origin FROM cat "
    "WHERE sid IS NOT NULL UNION ALL SELECT t.session_id, t.root_uri, c.uri, list_append(t.path, c.uri), t.depth + 1, c.title, "
    "c.origin FROM tree t JOIN cat c ON c.parent = t.chat_uri WHERE NOT list_contains(t.path, c.uri))"
)
_VERSIONS = (
    "vs AS (SELECT chat_id, load_no, CASE WHEN (chat_id + load_no) % 3 <> 0 THEN title || ' v' || load_no END AS title, "
    "CASE WHEN (chat_id + load_no) % 4 <> 1 THEN last_ms + (chat_id * load_no) % 5 * 1000 END AS last_ms "
    "FROM (SELECT *, unnest([0, 1, 2])::INT AS load_no FROM sc) v)"
)


def _sql(*parts: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts[:-1])} {parts[-1]}"


ORACLES = {
    "q_tool_calls": _sql(
        _CHATS, _CALLS,
        "SELECT chat_id, request_no, slot, sub_no, child_no, call_id, name, args, description, parent_id, mcp_server FROM tc",
    ),
    "q_chat_steps": _sql(
        _CHATS, _CALLS, _STEPS, "SELECT *, duration_ms > 120000 AS is_significant_pause FROM cs"
    ),
    "q_turn_histogram": _sql(
        _CHATS,
        "z AS (SELECT chat_id, count(*) AS n FROM rq GROUP BY chat_id)",
        "SELECT b AS bucket, count(chat_id) AS chats FROM (VALUES ('1 request', 1, 1), ('2-3 requests', 2, 3), "
        "('4-5 requests', 4, 5), ('6+ requests', 6, 1000000)) t(b, lo, hi) LEFT JOIN z ON n BETWEEN lo AND hi GROUP BY b",
    ),
    "q_keywords": _words("documents"),
    "q_prompt_keywords": _words("conversations", "role = 'user'"),
    "q_chat_latest": _sql(
        _CHATS, _VERSIONS,
        "SELECT chat_id, load_no, title, last_ms FROM vs QUALIFY row_number() OVER (PARTITION BY chat_id "
        "ORDER BY coalesce(last_ms, 0) DESC, load_no DESC) = 1",
    ),
    "q_chat_titles_merged": _sql(
        _CHATS, _VERSIONS,
        "SELECT chat_id, first(title ORDER BY coalesce(last_ms, 0) DESC, load_no DESC) FILTER (WHERE title IS NOT NULL) "
        "AS title, first(last_ms ORDER BY last_ms DESC, load_no DESC) FILTER (WHERE last_ms IS NOT NULL) AS last_ms FROM vs "
        "GROUP BY chat_id",
    ),
    "q_chat_tree": _sql(
        _CATALOG,
        "SELECT session_id, root_uri, chat_uri, array_to_string(path, '>') AS path, depth, title, origin FROM tree "
        "WHERE depth > 0",
    ),
    "q_catalog_attach": _sql(
        _CATALOG,
        "SELECT 's' || r_regionkey AS session_id, r_name, c AS child_chats FROM region LEFT JOIN (SELECT session_id, "
        "count(*) AS c FROM tree WHERE depth = 1 GROUP BY session_id) q ON q.session_id = 's' || r_regionkey",
    ),
    "q_title_match_nearest": _sql(
        TE_SQL, _FLAGS, _THREADS, _CHATS, _BOUND, _SCORED.format(name="m", list_no=0, where="true"),
        "SELECT session_id, thread_no, chat_id, score FROM m QUALIFY row_number() OVER (PARTITION BY session_id, thread_no "
        "ORDER BY score, created_ms, chat_id) = 1",
    ),
    "q_title_match_exclusive": _sql(
        TE_SQL, _FLAGS, _THREADS, _CHATS, _MATCH, "SELECT session_id, thread_no, chat_id, matched_title FROM mm"
    ),
    "q_matched_thread_titles": _sql(
        TE_SQL, _FLAGS, _THREADS.replace("coalesce(detected_title, first_prompt, CASE",
                                         "coalesce(detected_title, first_prompt, CASE WHEN thread_no % 3 = 0 AND fa.l = "
                                         "'Chat request' THEN 'Chat thread' "),
        _CHATS, _MATCH,
        "SELECT session_id, thread_no, coalesce(matched_title, own_title) AS title FROM mm",
    ),
    "q_thread_chat_steps": _sql(
        TE_SQL, _FLAGS, _THREADS, _CHATS, _CALLS, _STEPS, _MATCH,
        "SELECT session_id, thread_no, step_ms, actor, phase, label, detail, 'chat' AS source FROM mm JOIN cs USING (chat_id) "
        "UNION ALL SELECT session_id, thread_no, ms, actor, phase, label, detail, 'signals' FROM steps SEMI JOIN "
        "(SELECT * FROM mm WHERE chat_id IS NULL) u USING (session_id, thread_no)",
    ),
    "q_union_sessions": _sql(
        TE_SQL, _FLAGS, _SEGMENTS, _SUMMARY, _THREADS, CU_SQL, _FIRST,
        "nt AS (SELECT session_id, title FROM full_threads WHERE has_selectable_title AND step_count > 0 "
        "QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY started_ms DESC, thread_no) = 1)",
        "SELECT session_id, coalesce(title, date) AS title, date, total_actions FROM ss LEFT JOIN nt USING (session_id) "
        "UNION ALL SELECT 'cli:' || session_id, 'order ' || session_id, min(call_date), count(*) FROM rec GROUP BY session_id",
    ),
    "q_date_spine": _sql(
        RAW_SQL, _LL, _DAILY, CU_SQL, _FIRST,
        "cd AS (SELECT call_date AS date, count(*) AS cli_calls FROM rec GROUP BY call_date)",
        "SELECT date, coalesce(shown, 0) AS shown, coalesce(accepted, 0) AS accepted, coalesce(chat, 0) AS chat, "
        "coalesce(cli_calls, 0) AS cli_calls FROM daily FULL OUTER JOIN cd USING (date)",
    ),
    "q_signal_union": _sql(
        TE_SQL, RAW_SQL, _LX,
        "ds AS (SELECT ms, unnest(CASE k % 10 WHEN 1 THEN ['tool-loop-stop'] WHEN 2 THEN ['command-executed', "
        "'command-executed', 'command-executed'] WHEN 3 THEN ['thread-title'] WHEN 4 THEN ['memory-boundary'] "
        "WHEN 5 THEN ['chat-request'] WHEN 8 THEN CASE t % 3 WHEN 0 THEN ['plan-proposal'] WHEN 1 THEN ['chat-request'] "
        "ELSE ['plan-proposal', 'user-choice'] END WHEN 9 THEN CASE WHEN t % 2 = 0 THEN ['chat-request'] ELSE [] END "
        "ELSE [] END) AS signal_type FROM lx)",
        "SELECT event_type, signal_type, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM "
        "(SELECT event_type, signal_type, ms FROM te UNION ALL SELECT 'sessionSignal', signal_type, ms FROM ds) u GROUP BY 1, 2",
    ),
}
