"""Sessionization: threads, agent steps, episodes, fatigue and autonomous runs.

Every operator walks the events of a session in (ms, seq) order with the windows of `Sequence`, so a very large session
is processed in blocks. What looks like a state machine is stated as "the last marker before this row": the comments at
the episode rules give the argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import events as ev
from ..functions import text
from .ordered import Sequence

C = F.col
MINUTE_MS = 60_000

# Gaps that end an episode or a thread, the pause worth showing, and the fatigue threshold.
EPISODE_GAP_MS = 5 * MINUTE_MS
THREAD_GAP_MS = 10 * MINUTE_MS
FATIGUE_THRESHOLD = 3

KEY = ["session_id"]


def ordered(events: DataFrame, block_rows: int | None = None) -> Sequence:
    return Sequence(events, KEY, "ms", ["seq"], block_rows=block_rows)


# --- Autonomous time per session -------------------------------------------------------------------------------------


def _is_stop() -> Column:
    return ev.is_signal() & (C("signal_type") == "tool-loop-stop")


def _is_boundary() -> Column:
    return ev.is_signal() & (C("signal_type") == "memory-boundary")


def session_autonomous(rows: Sequence) -> DataFrame:
    """Autonomous time: from the first AI execution request to the next loop stop; a memory boundary cancels."""
    ends = _is_stop() | _is_boundary()
    segments = rows.running_sum({"segment": ends.cast("long")}, inclusive=False).frame()
    runs = segments.groupBy("session_id", "segment").agg(
        F.min(F.when(ev.is_ai_execution_request(), C("ms"))).alias("start_ms"),
        F.max(F.when(_is_stop(), C("ms"))).alias("stop_ms"),
    )
    length = F.greatest(C("stop_ms") - C("start_ms"), F.lit(0))
    return runs.groupBy("session_id").agg(
        F.sum(F.when(C("start_ms").isNotNull() & C("stop_ms").isNotNull(), length).otherwise(0)).alias("autonomous_ms")
    )


def session_summary(rows: Sequence) -> DataFrame:
    """Date, number of actions and autonomous time of each session with editor activity."""
    ends = _is_stop() | _is_boundary()
    segments = rows.running_sum({"segment": ends.cast("long")}, inclusive=False).frame()
    runs = segments.groupBy("session_id", "segment").agg(
        F.min("ms").alias("first_ms"),
        F.min(F.when(ev.is_ai_execution_request(), C("ms"))).alias("start_ms"),
        F.max(F.when(_is_stop(), C("ms"))).alias("stop_ms"),
        F.count_if(ev.is_actionable()).alias("actions"),
        F.bool_or(~ev.is_signal()).alias("edited"),
    )
    length = F.greatest(C("stop_ms") - C("start_ms"), F.lit(0))
    closed = C("start_ms").isNotNull() & C("stop_ms").isNotNull()
    return (
        runs.groupBy("session_id")
        .agg(
            F.date_format(F.timestamp_millis(F.min("first_ms")), "yyyy-MM-dd").alias("date"),
            F.sum("actions").alias("total_actions"),
            F.sum(F.when(closed, length).otherwise(0)).alias("autonomous_ms"),
            F.bool_or("edited").alias("edited"),
        )
        .where("edited")
        .drop("edited")
    )


# --- Threads ---------------------------------------------------------------------------------------------------------


def thread_rows(rows: Sequence, gap_ms: int = THREAD_GAP_MS) -> Sequence:
    """Number the threads of a session on each of its events (without editor switches).

    Adds thread_no (titles seen before the first thread belong to it), is_action (rows that can open a thread),
    parent_seq (the prompt a right-side action hangs under), run_no, is_step and step_ms (time to the next step).
    """
    is_title = ev.is_signal() & (C("signal_type") == "thread-title")
    rows = rows.where(C("event_type") != "editorSwitch").with_columns(
        {"is_title": is_title, "is_action": ~is_title & ~ev.is_metadata()}
    )
    entry = ev.timeline_entry()
    is_step = C("is_action") & ev.is_agent_step()
    rows = rows.with_columns({"label": entry["label"], "side": entry["side"], "is_step": is_step})
    rows = rows.last(
        {"prev_ms": F.when(~C("is_title"), C("ms")), "prev_action": F.when(C("is_action"), F.lit(1))}
    )
    idle = C("ms") - C("prev_ms") >= gap_ms
    opens = C("is_action") & (C("prev_action").isNull() | F.coalesce(idle, F.lit(False)) | ev.is_boundary_prompt())
    ends = C("is_action") & (_is_stop() | _is_boundary())
    rows = rows.running_sum({"opened": opens.cast("long")})
    rows = rows.running_sum({"run_no": ends.cast("long")}, inclusive=False)
    rows = rows.with_columns({"thread_no": F.greatest("opened", F.lit(1).cast("long"))})
    # The last left-side action decides whether a following right-side action is nested; as thread numbers only grow, a
    # left-side action of an earlier thread is recognised by its number.
    is_left = C("is_action") & (C("side") == "left")
    prompt = ~C("label").isin("Text change", "Completion accepted")
    rows = rows.last(
        {"left": F.when(is_left, F.struct("thread_no", prompt.alias("is_prompt"), C("seq").alias("left_seq")))}
    )
    under = C("is_action") & (C("side") == "right") & (C("left.thread_no") == C("thread_no")) & C("left.is_prompt")
    rows = rows.with_columns({"parent_seq": F.when(under, C("left.left_seq"))})
    rows = rows.next({"following": F.when(C("is_step"), F.struct("thread_no", C("ms").alias("next_ms")))})
    duration = F.when(
        C("is_step") & (C("following.thread_no") == C("thread_no")), C("following.next_ms") - C("ms")
    )
    rows = rows.with_columns({"step_ms": duration})
    return _drop(rows, "prev_ms", "prev_action", "opened", "left", "following")


def _drop(rows: Sequence, *names: str) -> Sequence:
    return rows._copy(rows.df.drop(*names))


def nested_actions(rows: Sequence) -> DataFrame:
    """Actions of the threads with the action they are nested under."""
    return rows.frame().where("is_action").select(
        "session_id", "thread_no", "seq", "ms", "label", "side", "parent_seq"
    )


def thread_steps(rows: Sequence, pause_ms: int = THREAD_GAP_MS) -> DataFrame:
    """Agent steps of each thread with the time to the next step."""
    step = ev.agent_step()
    return text.evaluate_once(rows.frame().where("is_step"), ev.texts()).select(
        "session_id", "thread_no", "seq", "ms", "actor", "phase", "intent", *[v.alias(k) for k, v in step.items()],
        C("step_ms").alias("duration_ms"), (C("step_ms") > pause_ms).alias("is_significant_pause"),
    )


def threads(rows: Sequence) -> DataFrame:
    """One row per thread: titles, accepted characters, autonomous time, first prompt and first action."""
    action, signal = C("is_action"), ev.is_signal()
    starts = action & ev.is_ai_execution_request() & ev.is_autonomous_signal()
    ends = action & (_is_stop() | _is_boundary())
    entry = ev.timeline_entry()
    first = F.struct(
        "label", F.when(signal, C("intent")).otherwise("").alias("intent"), entry["phase"].alias("phase"), "ms"
    )
    # Parts between loop ends first, so that each autonomous run is one row.
    parts = rows.frame().groupBy("session_id", "thread_no", "run_no").agg(
        F.min(F.when(starts, C("ms"))).alias("run_start"),
        F.max(F.when(ends, C("ms"))).alias("run_end"),
        F.min(F.when(action, C("ms"))).alias("started_ms"),
        F.max(F.when(action & C("parent_seq").isNull(), C("ms"))).alias("last_top_ms"),
        F.sum(F.when(action & (C("event_type") == "textChange"), F.greatest("chars_added", F.lit(0))).otherwise(0))
        .alias("chars"),
        F.bool_or(action & entry["is_autonomous"]).alias("autonomous_action"),
        F.bool_or(ev.is_metadata() & (C("intent") == "title")).alias("asked_title"),
        F.max(F.when(C("is_title"), F.struct("ms", "seq", "raw_text"))).alias("title"),
        F.min(F.when(action & signal & (C("actor") == "human"), F.struct("ms", "seq", "raw_text"))).alias("prompt"),
        F.min(F.when(action, F.struct("ms", "seq", first.alias("first")))).alias("first"),
        F.count_if(action).alias("actions"), F.count_if("is_step").alias("step_count"),
        F.max("step_ms").alias("longest_pause_ms"),
    )
    ended = C("run_end").isNotNull()
    closed = F.when(ended, F.greatest(C("run_end") - C("run_start"), F.lit(0)))
    merged = parts.groupBy("session_id", "thread_no").agg(
        F.min("started_ms").alias("started_ms"),
        F.coalesce(F.sum(closed), F.lit(0)).alias("closed_ms"),
        F.max(F.when(~ended, C("run_start"))).alias("open_start"),
        F.max("last_top_ms").alias("last_top_ms"),
        F.sum("chars").alias("accepted_chars"),
        F.bool_or("autonomous_action").alias("autonomous_action"),
        F.bool_or("asked_title").alias("saw_title_request"),
        F.max("title").alias("title"),
        F.min("prompt").alias("prompt"),
        F.min("first").alias("first"),
        F.sum("actions").alias("actions"), F.sum("step_count").alias("step_count"),
        F.coalesce(F.max("longest_pause_ms"), F.lit(0)).alias("longest_pause_ms"),
    )
    last_top = F.coalesce("last_top_ms", "started_ms")
    open_ms = F.coalesce(F.greatest(last_top - C("open_start"), F.lit(0)), F.lit(0))
    return (
        merged.where(C("actions") > 0)
        .withColumn("autonomous_ms", C("closed_ms") + open_ms)
        .select(
            "session_id", "thread_no", "started_ms", "autonomous_ms",
            (C("autonomous_action") | (C("autonomous_ms") > 0)).alias("has_autonomous_run"),
            "accepted_chars", "saw_title_request", "actions", "step_count", "longest_pause_ms",
            C("title.raw_text").alias("detected_title"),
            C("prompt.raw_text").alias("first_prompt"),
            C("first.first").alias("first_action"),
        )
    )


def _thread_label() -> Column:
    # The names of threads by intent and by label.
    action, asked = C("first_action"), C("saw_title_request")
    intent, phase, label = action["intent"], action["phase"], action["label"]
    by_intent = ev.choose(
        [
            (intent == "", F.lit(None).cast("string")),
            (intent.isin("panel/editAgent", *ev.EDIT_INTENTS), "Editing session"),
            (intent == "apply_patch", "Patch thread"),
            (intent.isin(*ev.PLANNING_INTENTS), "Planning thread"),
            ((intent == "tool/searchSubagentTool") | intent.startswith("browser/"), "Research thread"),
            (ev.is_subagent_intent(intent),
             F.when(phase == "research", "Research thread").otherwise("Execution thread")),
            (intent == "terminal/runCommand", "Command thread"),
        ],
        F.lit(None).cast("string"),
    )
    by_label = ev.choose(
        [
            (label.isin("Conversation turn", "New chat prompt", "Chat request"),
             F.when(asked, "Chat thread").otherwise("New Chat")),
            (label == "Plan proposed", "Planning thread"),
            (label == "Research action", "Research thread"),
            (label == "Execution action", "Execution thread"),
            (label == "Edit file", "Editing thread"),
            (label == "Apply patch", "Patch thread"),
        ],
        label,
    )
    named = F.when(label == "New chat prompt", F.lit("New Chat")).otherwise(F.coalesce(by_intent, by_label))
    return F.concat(named, F.lit(" · "), F.date_format(F.timestamp_millis(action["ms"]), "HH:mm"))


def with_titles(threads_: DataFrame) -> DataFrame:
    """Title of a thread: matched chat title, detected title, prompt, else a synthetic label (not selectable)."""
    matched = C("matched_title") if "matched_title" in threads_.columns else F.lit(None).cast("string")
    real = F.coalesce(
        F.nullif(matched, F.lit("")), F.nullif("detected_title", F.lit("")), text.prompt_title(C("first_prompt"))
    )
    return threads_.withColumns(
        {"title": F.coalesce(real, _thread_label()), "has_selectable_title": real.isNotNull()}
    )


def session_list(rows: Sequence, titled_threads: DataFrame) -> DataFrame:
    """Sessions with editor activity and the title of their newest titled thread that has steps, else their date.

    Newest date first, then most actions, then id.
    """
    newest = (
        titled_threads.where(C("has_selectable_title") & (C("step_count") > 0))
        .groupBy("session_id")
        # Threads that start together: the earlier one stays in front.
        .agg(F.max_by("title", F.struct(C("started_ms"), -C("thread_no"))).alias("thread_title"))
    )
    listed = session_summary(rows).join(newest, "session_id", "left")
    named = listed.withColumn("title", F.coalesce("thread_title", "date")).drop("thread_title")
    return named.orderBy(C("date").desc(), C("total_actions").desc(), "session_id")


# --- Episodes and fatigue --------------------------------------------------------------------------------------------


def episode_rows(rows: Sequence, gap_ms: int = EPISODE_GAP_MS) -> Sequence:
    """Number the episodes of a session on each of its events.

    An actionable event opens an episode if (a) it is the first, comes more than `gap_ms` after the previous action or
    follows a memory boundary; (b) it is a plan proposal and the current episode had a human or AI action; (c) it is an
    AI request and the current episode had a completed loop.

    Only (a) is independent of the state of the episode. For (b): of all human/AI actions, plan proposals and openings
    by (a), look at the last one before the proposal. If it is a human/AI action, it lies in the current episode, since
    nothing after it can have opened one. Otherwise it is a proposal (or opening) without any human/AI action since: if
    there was such an action earlier in the episode, that proposal already opened a new one. For (c), likewise with loop
    stops against AI requests, openings by (a) and proposals that opened by (b).
    """
    signal, kind = ev.is_signal(), C("signal_type")
    rows = rows.with_columns({"actionable": ev.is_actionable()})
    act = C("actionable")
    rows = rows.last({"prev": F.when(act, F.struct(C("ms").alias("ms"), _is_boundary().alias("boundary")))})
    hard = act & (C("prev").isNull() | (C("ms") - C("prev.ms") > gap_ms) | C("prev.boundary"))
    rows = rows.with_columns({"hard": F.coalesce(hard, F.lit(False))})

    moves = act & (~signal | C("actor").isin("ai", "human"))
    plan = act & signal & (kind == "plan-proposal")
    rows = rows.last({"mark": F.when(moves, "move").when(plan | C("hard"), "open")})
    rows = rows.with_columns({"by_plan": F.coalesce(plan & ~C("hard") & (C("mark") == "move"), F.lit(False))})

    stop = act & _is_stop()
    request = act & signal & (kind == "chat-request") & (C("actor") == "ai")
    rows = rows.last({"mark": F.when(stop, "stop").when(C("by_plan") | C("hard") | request, "open")})
    # A completed loop closes its episode at the new request, also if the gap alone would have ended it earlier.
    by_loop = request & ~C("prev.boundary") & (C("mark") == "stop")
    rows = rows.with_columns({"by_loop": F.coalesce(by_loop, F.lit(False))})

    opens = C("hard") | C("by_plan") | C("by_loop")
    rows = rows.running_sum({"episode_no": opens.cast("long")})
    ai = act & signal & (C("actor") == "ai")
    rows = rows.last({"ai_episode": F.when(ai, C("episode_no"))})
    rows = rows.next({"after": F.when(act, F.struct("by_loop", C("ms").alias("ms")))})
    return _drop(rows, "prev", "mark", "hard", "by_plan")


def timeline(rows: Sequence) -> DataFrame:
    """Timeline entries of the sessions with the episode they belong to."""
    entry = ev.timeline_entry()
    shown = [entry[c].alias(c) for c in ("actor", "phase", "label", "detail", "accepted")]
    actions = text.evaluate_once(rows.frame().where("actionable"), ev.texts())
    return actions.select("session_id", "seq", "ms", *shown, "episode_no")


def episodes(rows: Sequence) -> DataFrame:
    """One row per episode: times, action counts, acceptance, boundary, phases and models in order of appearance."""
    act, signal = C("actionable"), ev.is_signal()
    grown = (C("event_type") == "textChange") & (C("chars_added") > 0) & (C("ai_episode") == C("episode_no"))
    accepted = act & ((C("event_type") == "completionAccept") | F.coalesce(grown, F.lit(False)))
    human = act & (~signal | (C("actor") == "human"))
    last_end = F.when(C("after.by_loop"), C("after.ms")).otherwise(C("ms"))
    model = F.when(act & signal, F.nullif("model_name", F.lit("")))
    # Partial rows per phase and model of an episode keep the lists below as short as the number of phases and models.
    parts = (
        rows.with_columns({"phase_seen": F.when(act, ev.timeline_entry()["phase"]), "model_seen": model})
        .frame().where(C("episode_no") > 0)
        .groupBy("session_id", "episode_no", "phase_seen", "model_seen")
        .agg(
            F.min(F.when(act, F.struct("ms", "seq"))).alias("first_at"),
            F.max(F.when(act, F.struct("ms", "seq", last_end.alias("end_ms"), _is_boundary().alias("boundary"),
                                       C("after").isNull().alias("final")))).alias("last"),
            F.max("ms").alias("any_ms"),
            F.count_if(act & signal & (C("actor") == "ai")).alias("ai_actions"),
            F.count_if(human).alias("human_actions"),
            F.bool_or(accepted).alias("accepted"),
            F.bool_or(act & _is_boundary()).alias("context_boundary"),
        )
    )
    seen = lambda column: F.array_distinct(
        F.transform(
            F.array_sort(F.collect_list(F.when(C(column).isNotNull(), F.struct("first_at", C(column).alias("name"))))),
            lambda item: item["name"],
        )
    )
    merged = parts.groupBy("session_id", "episode_no").agg(
        F.min("first_at.ms").alias("started_ms"), F.max("last").alias("last"), F.max("any_ms").alias("any_ms"),
        F.sum("ai_actions").alias("ai_actions"), F.sum("human_actions").alias("human_actions"),
        F.bool_or("accepted").alias("accepted"), F.bool_or("context_boundary").alias("context_boundary"),
        seen("phase_seen").alias("phases"), seen("model_seen").alias("models"),
    )
    # The last episode stays open until the last event of the session unless a boundary closed it.
    ended = F.when(C("last.final") & ~C("last.boundary"), C("any_ms")).otherwise(C("last.end_ms"))
    # The summaries of episodes.
    summary = ev.choose(
        [
            (C("context_boundary"), "Context refresh boundary reached"),
            (C("accepted"), "Human confirmed the episode outcome"),
            (C("ai_actions") > C("human_actions"), "AI actions outpaced human confirmation"),
        ],
        "Human-led interaction",
    )
    return merged.select(
        "session_id", "episode_no", "started_ms", ended.alias("ended_ms"), "ai_actions", "human_actions", "accepted",
        "context_boundary", "phases", "models", summary.alias("summary"),
    )


def fatigue(episodes_: DataFrame, rows: Sequence) -> DataFrame:
    """Fatigue score and reasons of each episode. `rows` is the sequence the episodes were made from."""
    steps = Sequence(episodes_, KEY, "episode_no", parent=rows)
    steps = steps.last({"previous_accepted": C("accepted")})
    steps = steps.next({"has_next": F.lit(True)})
    steps = steps.running_sum({"accepted_so_far": C("accepted").cast("long")})
    ratio = C("accepted_so_far") / C("episode_no")
    several = (C("episode_no") > 1) | C("has_next").isNotNull()
    both = F.array_contains("phases", "research") & F.array_contains("phases", "execution")
    degraded = ~C("accepted") & ~F.coalesce("previous_accepted", F.lit(True))
    # Condition, points, reason.
    rules = [
        (C("ai_actions") >= 4, 1, "autonomous depth increased"),
        (both & ~C("accepted"), 1, "research did not convert into execution outcome"),
        (~C("accepted") & (C("ai_actions") > C("human_actions")), 1, "AI actions outpaced human confirmation"),
        (C("context_boundary"), 2, "refresh boundary occurred"),
        (degraded, 1, "degraded episodes continued"),
        (several & (ratio < 0.4), 1, "session confirmation ratio weakened"),
    ]
    score = sum((F.when(condition, points).otherwise(0) for condition, points, _ in rules), F.lit(0))
    reasons = F.concat_ws(", ", *[F.when(condition, F.lit(reason)) for condition, _, reason in rules])
    return steps.with_columns({"fatigue_score": score, "reason": reasons}).frame().drop(
        "previous_accepted", "has_next", "accepted_so_far"
    )


def fatigue_markers(scored: DataFrame) -> DataFrame:
    """First episode of each session whose score reaches the threshold."""
    marker = F.min_by(F.struct("episode_no", "ended_ms", "fatigue_score", "reason"), "episode_no")
    return (
        scored.where(C("fatigue_score") >= FATIGUE_THRESHOLD).groupBy("session_id").agg(marker.alias("marker"))
        .select("session_id", "marker.*")
    )


def fallback_summaries(by_session: DataFrame) -> DataFrame:
    """Session summaries from log counters only; the date is read out of the session id."""
    stamp = F.regexp_extract("session_id", r"\d{8}", 0)
    date = F.when(
        stamp != "", F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2))
    ).otherwise(C("session_id"))
    return by_session.select(
        "session_id", date.alias("title"), date.alias("date"),
        (C("shown") + C("accepted") + C("chat") + C("errors")).alias("total_actions"),
        F.lit(0).cast("long").alias("autonomous_ms"),
    )
