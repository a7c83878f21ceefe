"""Prompts, responses, tools and models of CLI sessions, in event order.

Input tables carry session_id and an order: a numeric `time` and, for ties, `seq`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import text
from .ordered import Sequence

C = F.col
KEY = ["session_id"]
UNTITLED = "CLI session"


def _sequence(df: DataFrame, keys: list[str], block_rows: int | None = None) -> Sequence:
    return Sequence(df, keys, "time", ["seq"], block_rows=block_rows)


# --- Prompts and responses -------------------------------------------------------------------------------------------
# `messages`: kind (start, prompt, agent, reply), content, message_id, origin_id, parent_tool_call, output_tokens,
# has_tool_requests.


def prompt_outcomes(messages: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row per human prompt: its length bucket and whether an answer was seen before the next prompt.

    The ids of prompt and reply must agree where both are known; once an agent message came in between, they must be
    known and agree.
    """
    opens = C("kind").isin("start", "prompt")
    rows = _sequence(messages, KEY, block_rows).running_sum({"turn": opens.cast("long")})
    rows = rows.last({
        "prompt": F.when(opens, F.struct("kind", "message_id")),
        "agent_turn": F.when(C("kind") == "agent", C("turn")),
    })
    agent_seen = F.coalesce(C("agent_turn") == C("turn"), F.lit(False))
    asked, origin = C("prompt.message_id"), C("origin_id")
    same = F.coalesce(asked == origin, F.lit(False))
    ids_fit = F.when(agent_seen, same).otherwise(asked.isNull() | origin.isNull() | same)
    has_text = F.coalesce(text.strip(C("content")) != "", F.lit(False))
    said = has_text | ((C("output_tokens") > 0) & ~C("has_tool_requests"))
    answers = (C("kind") == "reply") & (C("prompt.kind") == "prompt") & C("parent_tool_call").isNull() & ids_fit & said
    first = F.min(F.when(C("kind") == "prompt", F.struct("time", "seq", F.length("content").alias("chars"))))
    turns = rows.frame().groupBy("session_id", "turn").agg(
        first.alias("first"), F.coalesce(F.bool_or(answers), F.lit(False)).alias("answered")
    )
    return turns.where(C("first").isNotNull()).select(
        "session_id", "turn", C("first.chars").alias("chars"),
        text.prompt_bucket(C("first.chars")).alias("bucket"), "answered",
    )


def prompt_buckets(outcomes: DataFrame) -> DataFrame:
    """Prompts and answers per length bucket with the coordinates of a bubble chart."""
    counts = outcomes.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("shown"), F.count_if("answered").alias("answered")
    )
    middle = F.create_map(*[F.lit(v) for label, _, mid in text.PROMPT_BUCKETS for v in (label, mid)])
    return counts.select(
        "bucket", "shown", "answered", F.element_at(middle, C("bucket")).alias("x"),
        (F.floor(C("answered") / C("shown") * 1000 + 0.5) / 10).alias("y"),
        F.greatest(F.lit(4), F.floor(F.sqrt("shown") * 3 + 0.5).cast("int")).alias("r"),
    )


def turn_usage(messages: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Usage of the model calls after each user message, human or agent (columns as in `messages`, plus usage_tokens)."""
    opens = C("kind").isin("prompt", "agent")
    rows = _sequence(messages, KEY, block_rows).running_sum({"turn": opens.cast("long")})
    rows = rows.last({"opened_by": F.when(opens | (C("kind") == "start"), C("kind"))}, inclusive=True)
    live = rows.frame().where(C("opened_by") != "start")
    first = F.min(F.when(opens, F.struct("time", "seq", "kind", text.preview(C("content")).alias("prompt"))))
    return live.groupBy("session_id", "turn").agg(
        first.alias("first"), F.coalesce(F.sum("usage_tokens"), F.lit(0)).alias("tokens")
    ).select(
        "session_id", "turn", C("first.prompt").alias("prompt"),
        F.when(C("first.kind") == "agent", "ai").otherwise("human").alias("actor"), "tokens",
    )


def cli_steps(turns: DataFrame) -> DataFrame:
    """Agent steps of a CLI session: one prompt step per turn."""
    is_ai = C("actor") == "ai"
    return turns.select(
        F.concat(F.lit("cli:"), "session_id").alias("session_id"), "turn", "actor",
        F.when(is_ai, "execution").otherwise("human").alias("phase"), F.lit("Prompt").alias("label"),
        text.or_else(C("prompt"), F.lit("(No prompt preview)")).alias("detail"), "tokens",
    )


def session_titles(messages: DataFrame) -> DataFrame:
    """Title of a session: its last explicit title, else its first human prompt, else a label with the session id.

    `messages` also has rows of kind `title`; a start row may carry a title in `content` (null if none).
    """
    at = F.struct("time", "seq")
    given = C("kind").isin("start", "title") & C("content").isNotNull()
    given = given & ((C("kind") == "start") | (text.strip(C("content")) != ""))
    title = F.when(C("kind") == "start", C("content")).otherwise(text.strip(C("content")))
    prompt = text.preview(C("content"))
    asked = (C("kind") == "prompt") & (prompt != "")
    found = messages.groupBy("session_id").agg(
        F.max_by(F.substring(title, 1, text.PREVIEW_CHARS), F.when(given, at)).alias("explicit"),
        F.min_by(prompt, F.when(asked, at)).alias("asked"),
    )
    label = F.concat(F.lit(UNTITLED + " "), F.substring("session_id", 1, 8))
    explicit = F.nullif("explicit", F.lit(""))
    return found.select("session_id", F.coalesce(explicit, C("asked"), label).alias("title"))


def is_meaningful(prompts: Column, tokens: Column, nano: Column, runs: Column, decisions: Column) -> Column:
    """Threads worth listing: any prompt, token, unknown or positive credit, run or permission."""
    return (prompts > 0) | (tokens > 0) | nano.isNull() | (nano > 0) | (runs > 0) | (decisions > 0)


def project_folder(starts: DataFrame) -> DataFrame:
    """Project of a session: the first absolute path its first start names (columns: git_root, cwd)."""
    absolute = lambda c: F.when(C(c).startswith("/"), C(c))
    folder = F.min_by(F.coalesce(absolute("git_root"), absolute("cwd")), F.struct("time", "seq"))
    return starts.groupBy("session_id").agg(folder.alias("project"))


# --- As-of values ----------------------------------------------------------------------------------------------------


def tool_executions(calls: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Completed tool calls with their tool name: the own one, else that of the latest earlier start of the call.

    `calls`: session_id, call_id, time, seq, kind (start, complete), name, success, model.
    """
    known = C("call_id").isNotNull()
    rows = _sequence(calls.where(known), ["session_id", "call_id"], block_rows)
    rows = rows.last({"started_as": F.when(C("kind") == "start", C("name"))})
    done = rows.frame().where(C("kind") == "complete").withColumn("tool", F.coalesce("name", "started_as"))
    done = done.select(*[c for c in calls.columns if c != "name"], "tool")
    # Calls without an id belong to no start: they have their own name or none.
    alone = calls.where(~known & (C("kind") == "complete")).withColumnRenamed("name", "tool").select(*done.columns)
    return done.unionByName(alone).where(C("tool").isNotNull() & C("success").isNotNull())


def tool_totals(executions: DataFrame) -> DataFrame:
    counts = executions.groupBy("tool").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("succeeded"),
        F.count_if(~C("success")).alias("failed"),
    )
    return counts.withColumn("success_rate", C("succeeded") / C("total") * 100)


def tool_models(executions: DataFrame) -> DataFrame:
    return executions.groupBy("tool", "model").agg(F.count(F.lit(1)).alias("n"))


def model_in_force(events: DataFrame, default_model: str, block_rows: int | None = None) -> DataFrame:
    """Model of each message: its own, else the one set by the last session start or model change.

    `events`: session_id, time, seq, kind (start, change, message), model (nullable).
    """
    sets = F.when(C("kind") == "start", F.coalesce("model", F.lit(default_model))).when(
        C("kind") == "change", C("model")
    )
    rows = _sequence(events, KEY, block_rows).last({"in_force": sets})
    return rows.frame().where(C("kind") == "message").withColumn(
        "model", F.coalesce(C("model"), C("in_force"), F.lit(default_model))
    ).drop("in_force")


def date_in_force(events: DataFrame, today: str, block_rows: int | None = None) -> DataFrame:
    """Date of each event: its own, else the date of the last session start, else `today`.

    `events`: session_id, time, seq, kind (start or other), date (nullable).
    """
    rows = _sequence(events, KEY, block_rows)
    rows = rows.last({"start_date": F.when(C("kind") == "start", C("date"))})
    return rows.frame().withColumn("date", F.coalesce("date", "start_date", F.lit(today))).drop("start_date")


def agent_types(started: DataFrame) -> DataFrame:
    """Subagents by name with their share of all."""
    counts = started.where(F.coalesce("agent_name", F.lit("")) != "").groupBy("agent_name").agg(
        F.count(F.lit(1)).alias("n")
    )
    counts = settings.cut_lineage(counts)
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("agent_name", "n", (C("n") / total * 100).alias("share"))


def session_counters(events: DataFrame) -> DataFrame:
    """Prompts, turns, model changes and activity span per session (columns: kind, time)."""
    count = lambda kind: F.count_if(C("kind") == kind)
    return events.groupBy("session_id").agg(
        count("message").alias("interactions"), count("turn").alias("turns"), count("change").alias("model_changes"),
        F.min("time").alias("started_ms"), F.max("time").alias("last_activity_ms"),
    )
