"""Extraction of usage facts and session signals from extension-host log lines.

Input: `lines` with session_id, file, block_start, row and line (sources/logs.py). A line with an embedded JSON object is
read as JSON only; any other line is matched against the text rules, of which the first that applies wins.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import settings
from ..functions import events as ev
from ..functions import text
from .ordered import Sequence

C = F.col
LINE_KEY = ["session_id", "file"]

# Slash commands, participants and the JSON fields that may name a feature.
COMMANDS = [
    "/fix", "/explain", "/tests", "/test", "/doc", "/new", "/newNotebook", "/clear", "/help", "/search", "/simplify",
    "@workspace", "@terminal", "@vscode", "@github",
]
FEATURE_KEYS = [
    "event", "eventName", "intent", "toolName", "toolType", "pluginName", "skillName", "command", "action", "category",
    "sourceType", "contextType",
]
MODEL_KEYS = ["model", "modelId", "engineId", "engineName", "engine"]
CONVERSATION_KEYS = ["sessionId", "chatSessionId", "conversationId"]
PROMPT_TOKEN_KEYS = ["promptTokens", "prompt_tokens", "numPromptTokens", "numTokens", "tokenCount"]
COMPLETION_TOKEN_KEYS = ["completionTokens", "completion_tokens", "numCompletionTokens"]
TOTAL_TOKEN_KEYS = ["totalTokens", "total_tokens"]
TITLE_KEYS = ["title", "topic", "summary"]
CHAT_TURN_WORDS = ["chat/request", "chat.request", "chatrequest", "message.sent", "conversation.request"]
CODE_ACTION_WORDS = [
    "code.copy", "codeblock.copy", ".copy", "code.apply", "apply_patch", "workspace/editfile", "code.insert", ".insert",
]
# Fixed patterns of the text rules.
TIMESTAMP = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
DATE = r"\d{4}-\d{2}-\d{2}"
HOUR = r"\d{4}-\d{2}-\d{2} (\d{2}):"
SPACED_TIMESTAMP = r"\A(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2}:\d{2}(?:\.\d+)?)(?![A-Za-z+-])"
REQUEST_FAILURE = r"(?i)ccreq:\S+ \| (error|timeout|cancelled|failure) \|"
REQUEST_SUCCESS = r"\| success \| ([\w./\- >]+?) \| (\d+)ms \|"
REQUEST_INTENT = r"\[([a-zA-Z0-9/\-]+)\]\s*\z"
FETCH_STATUS = r"finished with (\d+) status"
FETCH_LATENCY = r"after ([\d.]+)ms"
FETCH_ENGINE = r"/v1/engines/([\w.-]+)/completions"
FINISH_REASON = r"(?i)finish reason:\s*\[([^\]]+)\]"
TERMINAL_MARK = "RunInTerminalTool#CommandLineAutoApproveAnalyzer: Parsed sub-commands via bash grammar"
TERMINAL_COMMANDS = r"(\[\[.*\]\])\z"


def _any(lower: Column, words: list[str]) -> Column:
    condition = F.lit(False)
    for word in words:
        condition = condition | lower.contains(word)
    return condition


def _first_variant(doc: Column, keys: list[str]) -> Column:
    """First of the alternative fields that is present and not null."""
    values = []
    for key in keys:
        value = F.try_variant_get(doc, f"$.{key}", "variant")
        values.append(F.when(~F.is_variant_null(value), value))
    return F.coalesce(*values)


def _text_of(value: Column) -> Column:
    """The value if it is a JSON string, else null."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def _number_of(value: Column) -> Column:
    """The value if it is a positive JSON number, rounded; else 0."""
    numeric = F.schema_of_variant(value).rlike(r"\A(BIGINT|DOUBLE|FLOAT|DECIMAL.*)\z")
    number = F.when(numeric, F.try_variant_get(value, "$", "double"))
    return F.when(number > 0, F.floor(number + 0.5)).otherwise(0).cast("long")


def line_timestamp(line: Column) -> Column:
    return normalise_timestamp(F.regexp_extract(line, TIMESTAMP, 0))


def normalise_timestamp(stamp: Column) -> Column:
    return F.regexp_replace(text.strip(stamp), SPACED_TIMESTAMP, "$1T$2")


def command_used(raw: Column) -> Column:
    """Canonical slash command or participant a text is or begins with, else null."""
    trimmed = text.strip(raw)
    # Only names in lower case can be recognised by prefix.
    prefix = F.regexp_extract(F.lower(trimmed), r"\A([/@][a-z]+)(?:[ :]|\z)", 1)
    return F.when(trimmed.isin(*COMMANDS), trimmed).when(prefix.isin(*[c for c in COMMANDS if c.islower()]), prefix)


# --- Facts per line --------------------------------------------------------------------------------------------------


def log_facts(lines: DataFrame) -> DataFrame:
    """One row per non-empty line with everything the counters need.

    Only the decision which rule applies is evaluated eagerly; all other columns are plain expressions of the line, so a
    query pays for the columns it reads.
    """
    line = C("line")
    candidate = F.when(line.contains("{") & line.contains("}"), F.regexp_extract(line, r"\{.*\}", 0))
    parsed = lines.where(line.rlike(f"[^{text.SPACE}]")).withColumns(
        {"doc": F.try_parse_json(candidate), "lower": F.lower(line)}
    )
    return _outputs(_outcomes(_rules(parsed)), lines.columns)


def _rules(parsed: DataFrame) -> DataFrame:
    """The rule a line falls under: JSON, else the first text rule that applies."""
    line, lower, doc = C("line"), C("lower"), C("doc")
    commands = F.from_json(F.regexp_extract(line, TERMINAL_COMMANDS, 1), "array<array<string>>")
    rules = [
        (doc.isNotNull(), "json"),
        (lower.contains("[toolcallingloop]") & lower.rlike(r"shouldcontinue\s*=\s*false"), "loop-stop"),
        (line.contains(TERMINAL_MARK) & commands.isNotNull(), "terminal"),
        (lower.contains("[streamchoices]") & lower.contains("finish reason:"), "finish"),
        (lower.contains("[fetchcompletions]") & lower.contains("finished with"), "fetch"),
        (line.contains("[AsyncCompletionManager]") & lower.contains("aborterror"), "abort"),
        (line.contains("ccreq:"), "request"),
    ]
    event = F.when(doc.isNotNull(), _text_of(_first_variant(doc, ["event", "eventName"])))
    return text.evaluate_once(parsed, {"rule": ev.choose(rules, "other"), "event": F.coalesce(event, F.lit(""))})


def _outcomes(ruled: DataFrame) -> DataFrame:
    """Completion outcome, request kind and error of a line."""
    line, lower, rule, event = C("line"), C("lower"), C("rule"), F.lower("event")
    failure = F.when(rule == "request", F.nullif(F.regexp_extract(line, REQUEST_FAILURE, 1), F.lit("")))
    status = F.when(rule == "fetch", F.coalesce(F.regexp_extract(line, FETCH_STATUS, 1).try_cast("int"), F.lit(0)))
    success = (rule == "request") & line.contains("| success |")
    basics = text.evaluate_once(ruled, {"failure": failure, "status": status, "success": success})
    ok = C("success") & C("failure").isNull()
    source = ev.choose(
        [
            (ok & lower.contains("[xtabprovider]"), "inline-shown"),
            (ok & lower.contains("[nes."), "inline-accepted"),
            (ok, "chat"),
        ],
        F.lit(None).cast("string"),
    )
    json_outcome = ev.choose(
        [
            (rule != "json", F.lit(None).cast("string")),
            (_any(event, ["shown", "displayed", "triggered"]), "shown"),
            (event.contains("accepted"), "accepted"),
            (_any(event, ["rejected", "dismissed"]), "rejected"),
        ],
        F.lit(None).cast("string"),
    )
    decided = text.evaluate_once(basics, {"source": source, "json_outcome": json_outcome})
    outcome = ev.choose(
        [
            (rule == "json", C("json_outcome")),
            ((C("status") == 200) | (C("source") == "inline-shown"), "shown"),
            (C("source") == "inline-accepted", "accepted"),
            (rule == "abort", "rejected"),
        ],
        F.lit(None).cast("string"),
    )
    return text.evaluate_once(decided, {"outcome": outcome})


def _outputs(decided: DataFrame, keep: list[str]) -> DataFrame:
    line, doc, rule, source = C("line"), C("doc"), C("rule"), C("source")
    is_json, is_fetch, event = rule == "json", rule == "fetch", F.lower("event")
    field = lambda keys: _text_of(_first_variant(doc, keys))
    json_stamp = normalise_timestamp(F.coalesce(field(["timestamp"]), line_timestamp(line)))
    own_session = F.nullif("session_id", F.lit(""))
    conversation = F.when(_first_variant(doc, CONVERSATION_KEYS).isNull(), own_session).otherwise(
        F.nullif(field(CONVERSATION_KEYS), F.lit(""))
    )
    is_turn, is_code = _any(event, CHAT_TURN_WORDS), _any(event, CODE_ACTION_WORDS)
    prompt = _number_of(_first_variant(doc, PROMPT_TOKEN_KEYS))
    completion = _number_of(_first_variant(doc, COMPLETION_TOKEN_KEYS))
    total = _number_of(_first_variant(doc, TOTAL_TOKEN_KEYS))
    latency = F.when(is_fetch, F.regexp_extract(line, FETCH_LATENCY, 1).try_cast("double")).when(
        source.isNotNull(), F.regexp_extract(line, REQUEST_SUCCESS, 2).try_cast("double")
    )
    features = F.filter(
        F.array(*[F.coalesce(field([k]), F.lit("")) for k in FEATURE_KEYS]), lambda value: value != ""
    )
    failure = F.concat(F.upper(F.substring("failure", 1, 1)), F.lower(F.expr("substr(failure, 2)")))
    bad_status = is_fetch & (C("status") > 0) & (C("status") != 200)
    commands = F.from_json(F.regexp_extract(line, TERMINAL_COMMANDS, 1), "array<array<string>>")
    return decided.select(
        *keep,
        "rule", "source", "event", "json_outcome", "outcome",
        F.when(is_json, F.array_join(features, " ")).otherwise(line).alias("feature_text"),
        F.when(rule == "terminal", F.flatten(commands)).alias("commands"),
        F.when(is_json, json_stamp).otherwise(line_timestamp(line)).alias("stamp"),
        F.when(is_json, F.substring(json_stamp, 1, 10)).otherwise(F.regexp_extract(line, DATE, 0)).alias("date"),
        F.when(is_json, "").otherwise(F.regexp_extract(line, HOUR, 1)).alias("hour"),
        F.when(is_json, text.normalize_model(F.coalesce(field(MODEL_KEYS), F.lit(""))))
        .when(is_fetch, F.regexp_extract(line, FETCH_ENGINE, 1))
        .when(source.isNotNull(), text.normalize_model(F.regexp_extract(line, REQUEST_SUCCESS, 1)))
        .otherwise("").alias("model"),
        F.coalesce(latency, F.lit(0.0)).alias("latency_ms"),
        F.when(source.isNotNull(), F.regexp_extract(line, REQUEST_INTENT, 1)).otherwise("").alias("intent"),
        F.when(C("failure").isNotNull(), failure)
        .when(bad_status, F.concat(F.lit("HTTP "), C("status").cast("string"))).alias("error_type"),
        (is_fetch | F.coalesce(source == "inline-shown", F.lit(False))).alias("session_shown"),
        (C("failure").isNotNull() | (is_fetch & (C("status") != 200))).alias("session_error"),
        F.when(is_json, command_used(field(["command", "action"]))).alias("command"),
        F.when(is_json & (is_turn | is_code), conversation)
        .when(source.isin("chat", "inline-accepted"), own_session).alias("chat_session_id"),
        F.when(is_json, is_turn).otherwise(source == "chat").alias("chat_turn"),
        F.when(is_json, is_code).otherwise(source == "inline-accepted").alias("code_action"),
        F.when(rule == "finish", F.lower(F.regexp_extract(line, FINISH_REASON, 1))).alias("finish_reason"),
        F.when(is_json, prompt).otherwise(0).alias("prompt_tokens"),
        F.when(is_json & (completion > 0), completion).when(is_json & (prompt == 0), total).otherwise(0)
        .alias("completion_tokens"),
    )


def is_chat() -> Column:
    return F.coalesce(C("source") == "chat", F.lit(False))


# --- Features and signals --------------------------------------------------------------------------------------------

# Words that mark a feature, and its subtypes (first match wins).
BROWSER_WORDS = ["playwright", "browser tool", "browsertool", "browser-", "browser_", "screenshot"]
PLUGIN_WORDS = [
    "agent-plugin", "[plugin", "[skill", "tool-call", "tool_call", "tool invocation", "toolinvocation", "invoketool",
    "invoke_tool",
]
PLUGIN_PATTERN = r"\b(?:plugin|skill)[:= ]"
PLUGIN_NAME = r"(?i)(?:agent-plugin|plugin|skill)(?:name)?[:= ]+([a-zA-Z0-9._/-]+)"
MEMORY_WORDS = [
    "/compact", "session memory", "session_memory", "context_limit_reached", "truncating_history", "truncating history",
    "context_limit", "context limit", "summarize_context", "summarize context", "compaction",
]
DEBUG_WORDS = ["agent-debug", "agent debug", "step-execution", "step execution", "breakpoint", "agent trace"]
BROWSER_TYPES = [
    (["playwright"], "playwright"),
    (["screenshot"], "screenshot"),
    (["browser-navigate", "browser_navigate", "browser tool: navigate"], "navigate"),
    (["browser tool", "browsertool", "browser-"], "browser"),
]
PLUGIN_TYPES = [
    (["agent-plugin"], "agent-plugin"),
    (["skill"], "skill"),
    (["[plugin"], "plugin"),
    (["tool-call", "tool_call"], "tool-call"),
    (["toolinvocation", "tool invocation"], "tool-invocation"),
    (["invoketool", "invoke_tool"], "invoke-tool"),
]
MEMORY_TYPES = [
    (["/compact"], "compact"),
    (["context_limit_reached"], "context-limit-reached"),
    (["truncating_history", "truncating history"], "truncating-history"),
    (["context_limit", "context limit"], "context-limit"),
    (["summarize_context", "summarize context"], "summarize"),
    (["session_memory", "session memory"], "session-memory"),
    (["compaction"], "compaction"),
]
DEBUG_TYPES = [
    (["step-execution", "step execution"], "step-execution"),
    (["breakpoint"], "breakpoint"),
    (["agent-debug", "agent debug"], "agent-debug"),
    (["agent trace"], "trace"),
]


def _subtype(lower: Column, table: list, default: str) -> Column:
    return ev.choose([(_any(lower, words), name) for words, name in table], default)


def feature_signals(facts: DataFrame) -> DataFrame:
    """One row per line and feature category: browser, plugin, memory, debug."""
    lower = F.lower("feature_text")
    name = F.regexp_extract("feature_text", PLUGIN_NAME, 1)
    plugin = ev.choose([(name != "", name)], _subtype(lower, PLUGIN_TYPES, "plugin-or-skill"))
    categories = [
        ("browser", _any(lower, BROWSER_WORDS), _subtype(lower, BROWSER_TYPES, "browser-tool")),
        ("plugin", _any(lower, PLUGIN_WORDS) | lower.rlike(PLUGIN_PATTERN), plugin),
        ("memory", _any(lower, MEMORY_WORDS), _subtype(lower, MEMORY_TYPES, "memory")),
        ("debug", _any(lower, DEBUG_WORDS), _subtype(lower, DEBUG_TYPES, "debug")),
    ]
    found = F.array_compact(
        F.array(*[
            F.when(condition, F.struct(F.lit(category).alias("category"), subtype.alias("subtype")))
            for category, condition, subtype in categories
        ])
    )
    return facts.withColumn("feature", F.explode(found)).withColumns(
        {"category": C("feature.category"), "subtype": C("feature.subtype")}
    ).drop("feature")


def feature_counts(features: DataFrame) -> DataFrame:
    """Subtype counts and, per category, the rows that count toward its total (memory needs a timestamp)."""
    counted = (C("category") != "memory") | (C("stamp") != "")
    return features.groupBy("category", "subtype").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(counted).alias("in_total")
    )


def _signal(kind, actor, phase, intent, raw, model, latency=None) -> Column:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        as_column(kind).alias("signal_type"), as_column(actor).alias("actor"), as_column(phase).alias("phase"),
        as_column(intent).alias("intent"), raw.alias("raw_text"), as_column(model).alias("model_name"),
        F.coalesce(latency if latency is not None else F.lit(0.0), F.lit(0.0)).alias("latency_ms"),
    )


def session_signals(facts: DataFrame) -> DataFrame:
    """Session signals of the lines (loop stops and titles come from `agent_loops` and `thread_titles`)."""
    is_json, line, model = C("rule") == "json", C("line"), C("model")
    plan_text = F.when(is_json, F.lower("event")).otherwise(F.lower("line"))
    plan_raw = F.when(is_json, C("event")).otherwise(line)
    plan_model = F.when(is_json, model).otherwise(text.normalize_model(F.regexp_extract(line, REQUEST_SUCCESS, 1)))
    lower = F.lower("feature_text")
    browser = _subtype(lower, BROWSER_TYPES, "browser-tool")
    signals = [
        F.when(_any(plan_text, ["agent/plan", "strategy/propose"]), _signal(
            "plan-proposal", "ai", "planning",
            F.when(plan_text.contains("strategy/propose"), "strategy/propose").otherwise("agent/plan"),
            plan_raw, plan_model)),
        F.when(_any(plan_text, ["workspace/editfile", "apply_patch"]), _signal(
            "chat-request", "ai", "execution",
            F.when(plan_text.contains("apply_patch"), "apply_patch").otherwise("workspace/editfile"),
            plan_raw, plan_model)),
        F.when(plan_text.contains("choice_selected"), _signal(
            "user-choice", "human", "human", "choice_selected", plan_raw, plan_model)),
        F.when(_any(lower, BROWSER_WORDS), _signal(
            "chat-request", "ai", "research", F.concat(F.lit("browser/"), browser), C("feature_text"), "")),
        F.when(_any(lower, MEMORY_WORDS), _signal(
            "memory-boundary", "system", "memory", _subtype(lower, MEMORY_TYPES, "memory"), C("feature_text"), "")),
        F.when((C("rule") == "fetch") & (C("outcome") == "shown"), _signal(
            "completion-shown", "ai", "execution", "fetchCompletions", line, model, C("latency_ms"))),
        F.when(C("source") == "inline-shown", _signal(
            "completion-shown", "ai", "execution", "XtabProvider", line, model, C("latency_ms"))),
        F.when(C("source") == "chat", _signal(
            F.when(C("intent") == "panel/unknown", "plan-proposal").otherwise("chat-request"),
            ev.classify(C("intent"), "actor"), ev.classify(C("intent"), "phase"), C("intent"), line, model,
            C("latency_ms"))),
    ]
    commands = F.transform(
        F.filter(
            F.transform(F.coalesce("commands", F.array().cast("array<string>")), lambda c: text.strip(c)),
            lambda c: F.coalesce(c, F.lit("")) != "",
        ),
        lambda c: _signal("command-executed", "ai", "execution", "terminal/runCommand", c, ""),
    )
    rows = facts.where((C("session_id") != "") & (C("stamp") != "")).select(
        "session_id", "file", "block_start", "row", "stamp",
        F.posexplode(F.concat(F.array_compact(F.array(*signals)), commands)).alias("part", "signal"),
    )
    return rows.select("session_id", "file", "block_start", "row", "part", "stamp", "signal.*")


class _Title(str):
    """A usable title found in a JSON object; decoding puts it in the object's place."""


def _object_title(pairs: list[tuple[str, object]]) -> _Title | None:
    """Called by the decoder for each object, inner ones first: its own title, else the first one inside."""
    own = dict(pairs)
    for key in TITLE_KEYS:
        if isinstance(own.get(key), str) and not isinstance(own[key], _Title):
            title = re.sub(r"^['\"`]+|['\"`]+$", "", " ".join(own[key].split()))[:80]
            if len(title) >= 4 and "://" not in title and not re.fullmatch(r"[a-fA-F0-9-]{20,}", title):
                return _Title(title)
    return _first_title(list(own.values()))


def _first_title(values: list) -> _Title | None:
    """In values that are decoded already; lists may hold lists."""
    waiting = values[::-1]
    while waiting:
        value = waiting.pop()
        if isinstance(value, _Title):
            return value
        if isinstance(value, list):
            waiting += value[::-1]
    return None


def thread_titles(lines: DataFrame) -> DataFrame:
    """Thread-title signals from JSON lines that carry a title, topic or summary at any depth."""

    @F.pandas_udf("string")
    def title_of(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: _first_title([json.loads(d, object_pairs_hook=_object_title)]))

    payload = F.regexp_extract("line", r"\{.*\}", 0)
    with_title = lines.where(
        payload.rlike(r'(?i)"(title|topic|summary)"\s*:') & F.try_parse_json(payload).isNotNull()
        & (C("session_id") != "")
    ).select(*LINE_KEY, "block_start", "row", line_timestamp(C("line")).alias("stamp"),
             title_of(payload).alias("title"))
    found = with_title.where(C("title").isNotNull() & (C("stamp") != ""))
    return found.select(
        *LINE_KEY, "block_start", "row", F.lit(0).alias("part"), "stamp",
        _signal("thread-title", "system", "planning", "thread-title", C("title"), "").alias("signal"),
    ).select(*LINE_KEY, "block_start", "row", "part", "stamp", "signal.*")


def agent_loops(facts: DataFrame, block_rows: int | None = None) -> DataFrame:
    """Subagent loops: from the first subagent request to the next loop stop, per session file."""
    wanted = facts.where((C("rule") == "loop-stop") | ev.is_subagent_intent(C("intent"))).select(
        *LINE_KEY, "block_start", "row", "rule", "model", "stamp", "line"
    )
    rows = Sequence(
        settings.cut_lineage(wanted),
        LINE_KEY, "block_start", ["row"], block_rows=block_rows,
    )
    is_stop = C("rule") == "loop-stop"
    segments = rows.running_sum({"loop_no": is_stop.cast("long")}, inclusive=False).frame()
    start = F.regexp_extract("line", r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?", 0)
    at = F.struct("block_start", "row")
    begins = ~is_stop & (start != "")
    # Within a loop, the first dated request sets start and model.
    loops = segments.groupBy(*LINE_KEY, "loop_no").agg(
        F.min_by(F.struct(start.alias("start"), "model"), F.when(begins, at)).alias("first"),
        F.max(F.when(is_stop, F.struct("block_start", "row", start.alias("stop"), "stamp", "line"))).alias("last"),
    )
    moment = lambda stamp: F.unix_millis(F.try_to_timestamp(F.regexp_replace(stamp, " ", "T")))
    duration = moment(C("last.stop")) - moment(C("first.start"))
    return loops.where(C("last").isNotNull()).select(
        *LINE_KEY, C("last.block_start").alias("block_start"), C("last.row").alias("row"), C("last.stamp").alias("stamp"),
        C("last.line").alias("line"), F.substring("first.start", 1, 10).alias("start_date"),
        F.coalesce("first.model", F.lit("")).alias("model"),
        F.greatest(F.coalesce(duration, F.lit(0)), F.lit(0)).cast("long").alias("duration_ms"),
    )


def loop_stop_signals(loops: DataFrame) -> DataFrame:
    signal = _signal("tool-loop-stop", "system", "execution", "tool-calling-loop-stop", C("line"), C("model"))
    return loops.where((C("session_id") != "") & (C("stamp") != "")).select(
        *LINE_KEY, "block_start", "row", F.lit(0).alias("part"), "stamp", signal.alias("signal")
    ).select(*LINE_KEY, "block_start", "row", "part", "stamp", "signal.*")


def signal_events(lines: DataFrame, facts: DataFrame) -> DataFrame:
    """All session signals of the log lines as rows of the events table."""
    signals = (
        session_signals(facts).unionByName(thread_titles(lines)).unionByName(loop_stop_signals(agent_loops(facts)))
    )
    ts = F.try_to_timestamp("stamp")
    return signals.where(ts.isNotNull()).select(
        "session_id", ts.alias("ts"), F.unix_millis(ts).alias("ms"),
        F.date_format(ts, "yyyy-MM-dd").alias("date"), F.lit("sessionSignal").alias("event_type"), "signal_type",
        "intent", "actor", "phase", F.lit("").alias("language_id"), "model_name", "latency_ms", "raw_text",
        F.lit(0).cast("long").alias("chars_added"), F.lit(0).cast("long").alias("chars_deleted"),
        F.lit(0).cast("long").alias("accepted_characters"), F.lit("").alias("file_path"),
        F.lit(True).alias("success"), "file", "block_start", "row", "part",
    )
