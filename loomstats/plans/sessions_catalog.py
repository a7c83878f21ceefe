"""Queries over sessions: threads, steps, episodes, fatigue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import sessions as ops
from .adapters import EPISODE_GAP_MS, PAUSE_MS, TE_SQL, THREAD_GAP_MS, tracked_events

C = F.col


def _rows(spark, sf):
    return ops.ordered(tracked_events(spark, sf))


def _thread_rows(spark, sf):
    return ops.thread_rows(_rows(spark, sf), THREAD_GAP_MS)


def _threads(spark, sf):
    return ops.with_titles(ops.threads(_thread_rows(spark, sf)))


def _episode_rows(spark, sf):
    return ops.episode_rows(_rows(spark, sf), EPISODE_GAP_MS)


def _episodes(spark, sf):
    return ops.episodes(_episode_rows(spark, sf)).withColumns(
        {"phases": F.array_join("phases", ","), "models": F.array_join("models", ",")}
    )


def _fatigue(spark, sf):
    rows = _episode_rows(spark, sf)
    return ops.fatigue(ops.episodes(rows), rows)


def _session_list(spark, sf):
    return ops.session_list(_rows(spark, sf), _threads(spark, sf))


QUERIES = {
    "q_session_autonomous": lambda s, d: ops.session_autonomous(_rows(s, d)),
    "q_session_summary": lambda s, d: ops.session_summary(_rows(s, d)),
    "q_nested_actions": lambda s, d: ops.nested_actions(_thread_rows(s, d)),
    "q_threads": lambda s, d: _threads(s, d).select(
        "session_id", "thread_no", "started_ms", "autonomous_ms", "has_autonomous_run", "accepted_chars", "actions",
        "step_count", "longest_pause_ms",
    ),
    "q_thread_titles": lambda s, d: _threads(s, d).select(
        "session_id", "thread_no", "detected_title", "first_prompt", "title", "has_selectable_title"
    ),
    "q_thread_detail": lambda s, d: _threads(s, d).where(C("step_count") > 0).select(
        "session_id", "thread_no", "title", "started_ms", "step_count"
    ),
    "q_steps_pauses": lambda s, d: ops.thread_steps(_thread_rows(s, d), PAUSE_MS),
    "q_timeline": lambda s, d: ops.timeline(_episode_rows(s, d)),
    "q_episodes": _episodes,
    "q_fatigue": lambda s, d: _fatigue(s, d).select("session_id", "episode_no", "fatigue_score", "reason"),
    "q_fatigue_markers": lambda s, d: ops.fatigue_markers(_fatigue(s, d)),
    "q_session_list": _session_list,
}

_FLAGS = (
    "tf AS (SELECT *, event_type = 'sessionSignal' AS sig, CASE WHEN event_type = 'textChange' THEN 'Text change' "
    "WHEN event_type = 'completionAccept' THEN 'Completion accepted' WHEN event_type = 'editorSwitch' "
    "THEN 'Editor switch' WHEN intent = 'vscodePrompt' THEN 'New chat prompt' "
    "WHEN signal_type = 'plan-proposal' THEN 'Plan proposed' WHEN signal_type = 'memory-boundary' "
    "THEN 'Memory Refreshed' WHEN signal_type = 'tool-loop-stop' THEN 'Autonomous loop completed' "
    "WHEN signal_type = 'completion-shown' THEN 'Suggestion shown' WHEN intent = 'apply_patch' THEN 'Apply patch' "
    "WHEN phase = 'research' THEN 'Research action' WHEN phase = 'execution' THEN 'Execution action' "
    "ELSE 'Chat request' END AS label, CASE WHEN event_type <> 'sessionSignal' OR actor = 'human' THEN 'left' "
    "WHEN actor = 'system' THEN 'center' ELSE 'right' END AS side, "
    "signal_type = 'tool-loop-stop' AS stop, signal_type = 'memory-boundary' AS bound, "
    "intent IN ('tool/runSubagent', 'apply_patch') AND signal_type = 'chat-request' AS ai_exec FROM te)"
)
_SEGMENTS = (
    "seg AS (SELECT *, coalesce(sum(CASE WHEN stop OR bound THEN 1 ELSE 0 END) OVER (PARTITION BY session_id "
    "ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sno FROM tf), "
    "runs AS (SELECT session_id, sno, min(ms) FILTER (WHERE ai_exec) AS s, max(ms) FILTER (WHERE stop) AS e "
    "FROM seg GROUP BY ALL), "
    "auto AS (SELECT session_id, CAST(sum(CASE WHEN e > s THEN e - s ELSE 0 END) AS BIGINT) AS autonomous_ms "
    "FROM runs GROUP BY session_id)"
)
_THREADS = (
    "t0 AS (SELECT *, signal_type = 'thread-title' AS is_title FROM tf WHERE event_type <> 'editorSwitch'), "
    "t1 AS (SELECT *, last_value(CASE WHEN NOT is_title THEN ms END IGNORE NULLS) OVER (PARTITION BY session_id "
    "ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_ms FROM t0), "
    "t2 AS (SELECT *, greatest(CAST(sum(CASE WHEN NOT is_title AND (prev_ms IS NULL OR ms - prev_ms >= 43200000 "
    "OR intent = 'vscodePrompt') THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY ms, seq "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT), 1) AS thread_no FROM t1), "
    "t3 AS (SELECT *, last_value(CASE WHEN side = 'left' AND NOT is_title THEN "
    "{'seq': seq, 'prompt': label NOT IN ('Text change', 'Completion accepted')} END IGNORE NULLS) OVER "
    "(PARTITION BY session_id, thread_no ORDER BY ms, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp "
    "FROM t2), "
    "t4 AS (SELECT *, CASE WHEN side = 'right' AND lp.prompt THEN lp.seq END AS parent_seq, "
    "coalesce(sum(CASE WHEN stop OR bound THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, thread_no ORDER BY ms, seq "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sno FROM t3), "
    "tops AS (SELECT session_id, thread_no, max(ms) AS top_ms FROM t4 WHERE NOT is_title AND parent_seq IS NULL "
    "GROUP BY ALL), "
    "tr AS (SELECT session_id, thread_no, sno, min(ms) FILTER (WHERE ai_exec) AS s, "
    "max(ms) FILTER (WHERE stop OR bound) AS e FROM t4 GROUP BY ALL), "
    "ta AS (SELECT session_id, thread_no, CAST(sum(CASE WHEN coalesce(e, top_ms) > s THEN coalesce(e, top_ms) - s "
    "ELSE 0 END) AS BIGINT) AS autonomous_ms FROM tr LEFT JOIN tops USING (session_id, thread_no) GROUP BY ALL), "
    "steps AS (SELECT session_id, thread_no, seq, ms, actor, phase, intent, raw_text AS detail, CASE "
    "WHEN intent = 'vscodePrompt' THEN 'Prompt' WHEN intent = 'apply_patch' THEN 'Updated' "
    "WHEN intent = 'tool/searchSubagentTool' THEN 'Searched' WHEN bound THEN 'Memory file' "
    "WHEN phase = 'planning' THEN 'Considered' ELSE 'Thought' END AS label, intent = 'tool/runSubagent' AS is_fallback, "
    "lead(ms) OVER (PARTITION BY session_id, thread_no ORDER BY ms, seq) - ms AS duration_ms FROM t4 "
    "WHERE sig AND NOT is_title AND NOT stop AND signal_type <> 'completion-shown'), "
    "stc AS (SELECT session_id, thread_no, count(*) AS step_count, max(duration_ms) AS longest_pause_ms FROM steps "
    "GROUP BY ALL), "
    "th AS (SELECT session_id, thread_no, min(ms) FILTER (WHERE NOT is_title) AS started_ms, "
    "bool_or(coalesce(NOT is_title AND (stop OR ai_exec OR intent = 'tool/searchSubagentTool'), false)) AS acted, "
    "CAST(sum(chars_added) AS BIGINT) AS accepted_chars, count(*) FILTER (WHERE NOT is_title) AS actions, "
    "last(raw_text ORDER BY ms, seq) FILTER (WHERE is_title) AS detected_title, "
    "first(raw_text ORDER BY ms, seq) FILTER (WHERE actor = 'human') AS first_prompt, "
    "first({'l': label, 'i': intent, 'p': phase, 'm': ts} ORDER BY ms, seq) FILTER (WHERE NOT is_title) AS fa "
    "FROM t4 GROUP BY ALL HAVING count(*) FILTER (WHERE NOT is_title) > 0), "
    "full_threads AS (SELECT th.*, autonomous_ms, acted OR autonomous_ms > 0 AS has_autonomous_run, "
    "coalesce(step_count, 0) AS step_count, coalesce(longest_pause_ms, 0) AS longest_pause_ms, "
    "coalesce(detected_title, first_prompt) IS NOT NULL AS has_selectable_title, "
    "coalesce(detected_title, first_prompt, CASE WHEN fa.i = 'apply_patch' THEN 'Patch thread' "
    "WHEN fa.i = 'panel/unknown' THEN 'Planning thread' WHEN fa.i = 'tool/searchSubagentTool' THEN 'Research thread' "
    "WHEN fa.i = 'tool/runSubagent' THEN 'Execution thread' ELSE fa.l END || ' · ' || strftime(fa.m, '%H:%M')) AS title "
    "FROM th JOIN ta USING (session_id, thread_no) LEFT JOIN stc USING (session_id, thread_no))"
)
_WALK = (
    "act AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ms, seq) AS rn, "
    "NOT sig OR actor IN ('ai', 'human') AS mv, signal_type = 'plan-proposal' AS plan, "
    "signal_type = 'chat-request' AND actor = 'ai' AS req, sig AND actor = 'ai' AS ai FROM tf "
    "WHERE event_type <> 'editorSwitch' AND signal_type NOT IN ('thread-title', 'completion-shown')), "
    "walk AS (SELECT session_id, rn, seq, ms, bound, CAST(1 AS BIGINT) AS ep, mv, stop AS lp, ai, false AS ai_before, "
    "false AS by_loop FROM act WHERE rn = 1 UNION ALL "
    "SELECT session_id, rn, seq, ms, bound, CASE WHEN split THEN ep + 1 ELSE ep END, "
    "CASE WHEN split THEN mv ELSE wmv OR mv END, CASE WHEN split THEN stop ELSE wlp OR stop END, "
    "CASE WHEN split THEN ai ELSE wai OR ai END, CASE WHEN split THEN false ELSE wai END, loop_split FROM "
    "(SELECT a.session_id, a.rn, a.seq, a.ms, a.bound, w.ep, a.mv, a.stop, a.ai, w.mv AS wmv, w.lp AS wlp, "
    "w.ai AS wai, NOT w.bound AND NOT (a.plan AND w.mv) AND w.lp AND a.req AS loop_split, "
    "w.bound OR (a.plan AND w.mv) OR (w.lp AND a.req) OR a.ms - w.ms > 21600000 AS split "
    "FROM walk w JOIN act a ON a.session_id = w.session_id AND a.rn = w.rn + 1) x)"
)
_EPISODES = (
    "ends AS (SELECT session_id, max(ms) AS end_ms FROM te GROUP BY session_id), "
    "w2 AS (SELECT walk.*, lead(walk.ms) OVER s AS next_ms, lead(walk.by_loop) OVER s AS next_loop, "
    "tf.actor, tf.event_type, tf.chars_added, tf.sig, tf.model_name, "
    "CASE WHEN tf.sig THEN tf.phase ELSE 'human' END AS vphase "
    "FROM walk JOIN tf USING (session_id, seq) WINDOW s AS (PARTITION BY walk.session_id ORDER BY rn)), "
    "ep0 AS (SELECT session_id, ep AS episode_no, min(ms) AS started_ms, "
    "last(CASE WHEN next_ms IS NULL AND NOT bound THEN NULL WHEN next_loop THEN next_ms ELSE ms END ORDER BY rn) AS em, "
    "count(*) FILTER (WHERE sig AND actor = 'ai') AS ai_actions, "
    "count(*) FILTER (WHERE NOT sig OR actor = 'human') AS human_actions, "
    "bool_or(event_type = 'completionAccept' OR (event_type = 'textChange' AND chars_added > 0 AND ai_before)) "
    "AS accepted, bool_or(bound) AS context_boundary, bool_or(vphase = 'research') AS res, "
    "bool_or(vphase = 'execution') AS exe FROM w2 GROUP BY ALL), "
    "ph AS (SELECT session_id, ep AS episode_no, string_agg(vphase, ',' ORDER BY f) AS phases FROM "
    "(SELECT session_id, ep, vphase, min(rn) AS f FROM w2 GROUP BY ALL) p GROUP BY ALL), "
    "mo AS (SELECT session_id, ep AS episode_no, string_agg(model_name, ',' ORDER BY f) AS models FROM "
    "(SELECT session_id, ep, model_name, min(rn) AS f FROM w2 WHERE sig AND model_name <> '' GROUP BY ALL) p "
    "GROUP BY ALL), "
    "ep1 AS (SELECT session_id, episode_no, started_ms, coalesce(em, end_ms) AS ended_ms, ai_actions, human_actions, "
    "accepted, context_boundary, res, exe, phases, coalesce(models, '') AS models, CASE WHEN context_boundary "
    "THEN 'Context refresh boundary reached' WHEN accepted THEN 'Human confirmed the episode outcome' "
    "WHEN ai_actions > human_actions THEN 'AI actions outpaced human confirmation' ELSE 'Human-led interaction' END "
    "AS summary FROM ep0 JOIN ends USING (session_id) JOIN ph USING (session_id, episode_no) "
    "LEFT JOIN mo USING (session_id, episode_no))"
)
_FATIGUE = (
    "f0 AS (SELECT *, row_number() OVER s - sum(accepted::INT) OVER s AS island, "
    "sum(accepted::INT) OVER s AS acc, count(*) OVER (PARTITION BY session_id) AS n FROM ep1 "
    "WINDOW s AS (PARTITION BY session_id ORDER BY episode_no)), "
    "f1 AS (SELECT *, CASE WHEN accepted THEN 0 ELSE row_number() OVER (PARTITION BY session_id, acc, accepted "
    "ORDER BY episode_no) END AS streak FROM f0), "
    "f2 AS (SELECT *, [ai_actions >= 4, res AND exe AND NOT accepted, NOT accepted AND ai_actions > human_actions, "
    "context_boundary, streak >= 2, n > 1 AND acc / episode_no < 0.4] AS r FROM f1), "
    "f3 AS (SELECT session_id, episode_no, ended_ms, CAST(list_sum(list_transform(r, lambda x: x::INT)) + r[4]::INT AS INT) "
    "AS fatigue_score, concat_ws(', ', CASE WHEN r[1] THEN 'autonomous depth increased' END, "
    "CASE WHEN r[2] THEN 'research did not convert into execution outcome' END, "
    "CASE WHEN r[3] THEN 'AI actions outpaced human confirmation' END, "
    "CASE WHEN r[4] THEN 'refresh boundary occurred' END, CASE WHEN r[5] THEN 'degraded episodes continued' END, "
    "CASE WHEN r[6] THEN 'session confirmation ratio weakened' END) AS reason FROM f2)"
)
_SUMMARY = (
    "ss AS (SELECT session_id, min(date) AS date, count(*) FILTER (WHERE event_type <> 'editorSwitch' "
    "AND signal_type NOT IN ('thread-title', 'completion-shown')) AS total_actions FROM te GROUP BY session_id "
    "HAVING bool_or(event_type <> 'sessionSignal'))"
)


def _te(*parts: str) -> str:
    return f"WITH RECURSIVE {', '.join([TE_SQL, _FLAGS, *parts[:-1]])} {parts[-1]}"


ORACLES = {
    "q_session_autonomous": _te(_SEGMENTS, "SELECT * FROM auto"),
    "q_session_summary": _te(_SEGMENTS, _SUMMARY, "SELECT * FROM ss JOIN auto USING (session_id)"),
    "q_nested_actions": _te(
        _THREADS, "SELECT session_id, thread_no, seq, ms, label, side, parent_seq FROM t4 WHERE NOT is_title"
    ),
    "q_threads": _te(
        _THREADS,
        "SELECT session_id, thread_no, started_ms, autonomous_ms, has_autonomous_run, accepted_chars, actions, "
        "step_count, longest_pause_ms FROM full_threads",
    ),
    "q_thread_titles": _te(
        _THREADS,
        "SELECT session_id, thread_no, detected_title, first_prompt, title, has_selectable_title FROM full_threads",
    ),
    "q_thread_detail": _te(
        _THREADS,
        "SELECT session_id, thread_no, title, started_ms, step_count FROM full_threads WHERE step_count > 0",
    ),
    "q_steps_pauses": _te(
        _THREADS,
        "SELECT session_id, thread_no, seq, ms, actor, phase, intent, label, detail, is_fallback, duration_ms, "
        "duration_ms > 43200000 AS is_significant_pause FROM steps",
    ),
    "q_timeline": _te(
        _WALK,
        "SELECT session_id, seq, walk.ms, CASE WHEN sig THEN actor ELSE 'human' END AS actor, "
        "CASE WHEN sig THEN phase ELSE 'human' END AS phase, label, CASE WHEN event_type = 'textChange' THEN "
        "'+' || chars_added || ' / -' || chars_deleted WHEN event_type = 'completionAccept' THEN "
        "CASE WHEN model_name = '' THEN 'Inline completion' ELSE model_name END WHEN intent = 'vscodePrompt' "
        "THEN 'New Chat' WHEN walk.bound THEN intent WHEN stop THEN CASE WHEN model_name = '' THEN intent "
        "ELSE model_name END WHEN intent = 'apply_patch' THEN raw_text ELSE intent END AS detail, "
        "event_type = 'completionAccept' OR stop OR (event_type = 'textChange' AND chars_added > 0) AS accepted, "
        "ep AS episode_no FROM walk JOIN tf USING (session_id, seq)",
    ),
    "q_episodes": _te(
        _WALK, _EPISODES,
        "SELECT session_id, episode_no, started_ms, ended_ms, ai_actions, human_actions, accepted, context_boundary, "
        "phases, models, summary FROM ep1",
    ),
    "q_fatigue": _te(
        _WALK, _EPISODES, _FATIGUE, "SELECT session_id, episode_no, fatigue_score, reason FROM f3"
    ),
    "q_fatigue_markers": _te(
        _WALK, _EPISODES, _FATIGUE,
        "SELECT * FROM f3 WHERE fatigue_score >= 3 QUALIFY row_number() OVER (PARTITION BY session_id "
        "ORDER BY episode_no) = 1",
    ),
    "q_session_list": _te(
        _SEGMENTS, _SUMMARY, _THREADS,
        "nt AS (SELECT session_id, title FROM full_threads WHERE has_selectable_title AND step_count > 0 "
        "QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY started_ms DESC, thread_no) = 1)",
        "SELECT ss.session_id, date, total_actions, autonomous_ms, coalesce(title, date) AS title FROM ss "
        "JOIN auto USING (session_id) LEFT JOIN nt USING (session_id)",
    ),
}
