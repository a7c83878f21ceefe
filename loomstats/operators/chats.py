"""Saved chats: tool calls, steps, catalog trees, keywords and versions.

Tables: `chats` (chat_id, title, created_ms, last_ms, first_text), `requests` (chat_id, request_no, ms, agent_id,
agent_name, model_id, text), `calls` (chat_id, request_no, pos, call_id, name), `results` (chat_id, request_no, call_id,
args) and `invocations` (chat_id, request_no, pos, call_id, tool_id, parent_id, is_subagent, description, mcp_server).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import events as ev
from ..functions import keywords, text
from .ordered import Sequence

C = F.col
REQUEST = ["chat_id", "request_no"]
SUBAGENT = "runSubagent"
AT_END = 1 << 40


# --- Tool calls ------------------------------------------------------------------------------------------------------


def tool_calls(calls: DataFrame, results: DataFrame, invocations: DataFrame) -> DataFrame:
    """Tool calls of the requests in display order, with arguments, server, subagent description and parent.

    Where a request recorded subagent invocations, they stand in place of its plain subagent calls, each followed by the
    calls made inside it. slot, sub_no and child_no give the order.
    """
    subs = (
        invocations.where((C("tool_id") == SUBAGENT) & C("call_id").isNotNull() & C("is_subagent"))
        .groupBy(*REQUEST, "call_id")
        .agg(F.min("pos").alias("sub_pos"), F.min_by(F.coalesce("description", F.lit("")), "pos").alias("description"))
    )
    slots = calls.groupBy(*REQUEST).agg(F.min(F.when(C("name") == SUBAGENT, C("pos"))).alias("slot"))
    placed = subs.join(slots, REQUEST, "left").withColumn("slot", F.coalesce("slot", F.lit(AT_END)))
    described = placed.select(
        *REQUEST, "slot", C("sub_pos").alias("sub_no"), F.lit(-1).cast("long").alias("child_no"), "call_id",
        F.lit(SUBAGENT).alias("name"), F.lit(None).cast("string").alias("args"), "description",
        F.lit(None).cast("string").alias("parent_id"),
    )
    inner = invocations.where(C("parent_id").isNotNull() & C("call_id").isNotNull()).select(
        *REQUEST, C("pos").alias("child_no"), "call_id", F.coalesce("tool_id", F.lit("")).alias("name"), "parent_id"
    )
    parents = placed.select(*REQUEST, "slot", C("sub_pos").alias("sub_no"), C("call_id").alias("parent_id"))
    children = inner.join(parents, [*REQUEST, "parent_id"]).select(
        *REQUEST, "slot", "sub_no", "child_no", "call_id", "name", F.lit(None).cast("string").alias("args"),
        F.lit(None).cast("string").alias("description"), "parent_id",
    )
    replaced = subs.select(*REQUEST).distinct().withColumn("replaced", F.lit(True))
    plain = (
        calls.join(results, [*REQUEST, "call_id"], "left").join(replaced, REQUEST, "left")
        .where(C("replaced").isNull() | (C("name") != SUBAGENT))
        .select(
            *REQUEST, C("pos").alias("slot"), F.lit(-1).cast("long").alias("sub_no"),
            F.lit(-1).cast("long").alias("child_no"), "call_id", "name", "args",
            F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("parent_id"),
        )
    )
    servers = invocations.where(C("tool_id").isNotNull() & C("mcp_server").isNotNull()).groupBy(
        *REQUEST, C("tool_id").alias("name")
    ).agg(F.min_by("mcp_server", "pos").alias("mcp_server"))
    return plain.unionByName(described).unionByName(children).join(servers, [*REQUEST, "name"], "left")


def chat_steps(
    chats: DataFrame, requests: DataFrame, calls: DataFrame, pause_ms: int, block_rows: int | None = None
) -> DataFrame:
    """Agent steps of saved chats: prompt, planning or answer, then one step per tool call, with pauses.

    Calls and steps are written once: each is read for its sizes and again for its rows, and takes several joins to make.
    """
    calls = settings.stored(calls)
    numbered = Sequence(calls, REQUEST, "slot", ["sub_no", "child_no"], block_rows=block_rows).row_number("call_no")
    counted = calls.groupBy(*REQUEST).agg(F.count(F.lit(1)).alias("calls"))
    base = requests.join(chats.select("chat_id", "created_ms"), "chat_id").join(counted, REQUEST, "left")
    base = base.withColumns(
        {"base_ms": F.when(C("ms") > 0, C("ms")).otherwise(C("created_ms")), "calls": F.coalesce("calls", F.lit(0))}
    )
    step = lambda part, offset, actor, phase, label, detail, intent, fallback: F.struct(
        F.lit(part).cast("long").alias("part"), (C("base_ms") + offset).alias("step_ms"), F.lit(actor).alias("actor"),
        phase.alias("phase"), F.lit(label).alias("label"), detail.alias("detail"), intent.alias("intent"),
        F.lit(fallback).alias("is_fallback"),
    )
    plural = F.when(C("calls") == 1, "").otherwise("s")
    planning = C("calls") > 0
    summary = F.when(planning, F.concat(C("calls").cast("string"), F.lit(" tool call"), plural)).otherwise(C("model_id"))
    fallback = F.when(planning, text.or_else(C("model_id"), F.lit("Assistant planning"))).otherwise(
        F.coalesce(F.concat(F.lit("Agent "), F.nullif("agent_name", F.lit(""))),
                   text.or_else(C("model_id"), F.lit("Assistant response")))
    )
    asked = F.when(
        text.strip(C("text")) != "",
        step(0, 0, "human", F.lit("human"), "Prompt", text.detail(text.collapse(C("text")), F.lit("Prompt")), F.lit("chat/request"), False),
    )
    thought = step(
        1, 1, "ai", F.when(planning, "planning").otherwise("execution"), "Thought",
        text.detail(F.coalesce("agent_name", summary), fallback), text.or_else(C("agent_id"), F.lit("chat/response")), True,
    )
    spoken = base.select(
        *REQUEST, C("ms").alias("request_ms"), F.inline(F.array_compact(F.array(asked, thought)))
    )
    kind = ev.tool_step(C("name"))
    parts = F.filter(
        F.array(*[text.strip(F.coalesce(c, F.lit(""))) for c in ("description", "mcp_server", "args")]),
        lambda value: value != "",
    )
    named = text.humanise(C("name"))
    tools = numbered.frame().join(base.select(*REQUEST, C("ms").alias("request_ms"), "base_ms"), REQUEST).select(
        *REQUEST, "request_ms", (C("call_no") + 1).alias("part"), (C("base_ms") + C("call_no") + 1).alias("step_ms"),
        kind["actor"].alias("actor"), kind["phase"].alias("phase"), kind["label"].alias("label"),
        text.detail(F.coalesce(F.try_element_at(parts, F.lit(1)), named), named).alias("detail"),
        C("name").alias("intent"), kind["is_fallback"].alias("is_fallback"),
    )
    steps = settings.stored(spoken.unionByName(tools))
    rows = Sequence(steps, ["chat_id"], "step_ms", ["request_ms", "request_no", "part"], block_rows=block_rows)
    duration = C("next_ms") - C("step_ms")
    return rows.next({"next_ms": C("step_ms")}).frame().withColumns(
        {"duration_ms": duration, "is_significant_pause": duration > pause_ms}
    ).drop("request_ms", "next_ms")


def steps_for_threads(threads: DataFrame, agent_steps: DataFrame, steps_of_chats: DataFrame) -> DataFrame:
    """Steps of each thread: those of its matched chat, else those of its own signals."""
    shown = ["session_id", "thread_no", "step_ms", "actor", "phase", "label", "detail", "source"]
    matched = threads.where(C("chat_id").isNotNull()).select("session_id", "thread_no", "chat_id")
    of_chat = matched.join(steps_of_chats, "chat_id").withColumn("source", F.lit("chat"))
    own = agent_steps.join(matched, ["session_id", "thread_no"], "left_anti").withColumns(
        {"source": F.lit("signals"), "step_ms": C("ms")}
    )
    return of_chat.select(*shown).unionByName(own.select(*shown))


# --- Chats -----------------------------------------------------------------------------------------------------------

# Request-count buckets.
TURN_BUCKETS = ["1 request", "2-3 requests", "4-5 requests", "6+ requests"]


def turn_histogram(requests: DataFrame) -> DataFrame:
    """Chats by number of requests; empty buckets are kept."""
    sizes = requests.groupBy("chat_id").agg(F.count(F.lit(1)).alias("n"))
    bucket = ev.choose(
        [(C("n") == 1, TURN_BUCKETS[0]), (C("n") <= 3, TURN_BUCKETS[1]), (C("n") <= 5, TURN_BUCKETS[2])], TURN_BUCKETS[3]
    )
    counts = sizes.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("chats"))
    spine = requests.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, TURN_BUCKETS))).alias("bucket"))
    return spine.join(counts, "bucket", "left").na.fill(0, ["chats"])


def latest_chats(versions: DataFrame) -> DataFrame:
    """Latest version of each chat by its last message; among equals the one loaded last (column load_no)."""
    rest = [c for c in versions.columns if c != "chat_id"]
    rank = F.struct(F.coalesce("last_ms", F.lit(0)), "load_no")
    return versions.groupBy("chat_id").agg(F.max_by(F.struct(*rest), rank).alias("latest")).select(
        "chat_id", "latest.*"
    )


def merged_titles(versions: DataFrame) -> DataFrame:
    """Title records merged field by field: a newer known value replaces an older one."""
    rank = F.struct(F.coalesce("last_ms", F.lit(0)), "load_no")
    fields = [c for c in versions.columns if c not in ("chat_id", "load_no")]
    return versions.groupBy("chat_id").agg(
        *[F.max_by(c, F.when(C(c).isNotNull(), rank)).alias(c) for c in fields]
    )


def top_keywords(texts: DataFrame, column: str, limit: int = 20) -> DataFrame:
    """Most frequent keywords (ties: word)."""
    pieces = texts.select(F.explode(keywords.raw_words(C(column))).alias("piece"))
    # Counting first leaves only the distinct pieces to be examined.
    distinct = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
    words = distinct.select(keywords.keyword(C("piece")).alias("word"), "n").where(C("word").isNotNull())
    counts = words.groupBy("word").agg(F.sum("n").alias("n"))
    return counts.orderBy(C("n").desc(), "word").limit(limit)


# --- Catalog ---------------------------------------------------------------------------------------------------------
# `catalog`: chat_uri, parent_chat, session_id (of the roots), title, origin.


def live_catalog(rows: DataFrame) -> DataFrame:
    """Catalog rows that are not tombstoned, with titles and origins read from their JSON columns."""
    summary = F.get_json_object("metadata", "$.data.summary")
    origin = F.get_json_object("origin", "$.kind")
    title = F.substring(text.collapse(F.coalesce(summary, F.lit(""))), 1, text.PREVIEW_CHARS)
    return rows.where(C("tombstoned") == 0).select(
        "chat_uri", "parent_chat", F.get_json_object("provider_data", "$.sdkSessionId").alias("session_id"),
        text.or_else(title, F.lit("Untitled chat")).alias("title"),
        F.when(origin.isin("tool", "user"), origin).alias("origin"),
    )


def chat_tree(catalog: DataFrame) -> DataFrame:
    """Descendants of every root chat, level by level; a chat is not entered twice on one path."""
    children = catalog.where(C("parent_chat").isNotNull() & C("chat_uri").isNotNull()).select(
        "parent_chat", C("chat_uri").alias("child_uri"), "title", "origin"
    )
    level = catalog.where(C("session_id").isNotNull() & C("chat_uri").isNotNull()).select(
        "session_id", C("chat_uri").alias("root_uri"), "chat_uri", F.array("chat_uri").alias("path")
    )
    found = None
    depth = 0
    while True:
        depth += 1
        grown = level.join(children, level["chat_uri"] == children["parent_chat"]).where(
            ~F.array_contains("path", C("child_uri"))
        )
        below = settings.cut_lineage(grown.select(
            "session_id", "root_uri", C("child_uri").alias("chat_uri"),
            F.concat("path", F.array("child_uri")).alias("path"), F.lit(depth).alias("depth"), "title", "origin",
        ))
        found = below if found is None else found.unionByName(below)
        if below.isEmpty():
            return found
        level = below.select("session_id", "root_uri", "chat_uri", "path")


def session_children(tree: DataFrame) -> DataFrame:
    """Number of direct child chats per session, from the root with the most of them."""
    per_root = tree.where(C("depth") == 1).groupBy("session_id", "root_uri").agg(F.count(F.lit(1)).alias("child_chats"))
    return per_root.groupBy("session_id").agg(F.max("child_chats").alias("child_chats"))


def with_children(threads: DataFrame, tree: DataFrame) -> DataFrame:
    return threads.join(session_children(tree), "session_id", "left")
