"""Predicates and classifications over tracked events, as Column expressions.

They read the columns of the `events` table: event_type, signal_type, intent, actor, phase, model_name, raw_text,
chars_added, chars_deleted, file_path. Texts built from several of them start from the columns of `texts()`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

C = F.col

# Intent tags and what they mean.
INTENT_NAMES = {
    "panel/editAgent": "Agent",
    "panel/unknown": "Plan",
    "title": "Title",
    "progressMessages": "Progress",
    "vscodePrompt": "Ask",
    "copilotLanguageModelWrapper": "Ask (Old)",
    "intentDetection": "Intent Detection",
}
SUBAGENT_INTENTS = ["tool/runSubagent", "panel/editAgent", "tool/searchSubagentTool"]
HUMAN_INTENTS = ["vscodePrompt", "copilotLanguageModelWrapper"]
METADATA_INTENTS = ["title", "progressMessages"]
PLANNING_INTENTS = ["panel/unknown", "agent/plan", "strategy/propose"]
EDIT_INTENTS = ["workspace/editfile", "workspace/editFile"]


def choose(rules: list[tuple[Column, object]], default: object) -> Column:
    """Value of the first rule whose condition holds."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def is_signal() -> Column:
    return C("event_type") == "sessionSignal"


def is_subagent_intent(intent: Column) -> Column:
    return intent.isin(*SUBAGENT_INTENTS) | intent.startswith("tool/runSubagent-")


def is_metadata() -> Column:
    return is_signal() & C("intent").isin(*METADATA_INTENTS)


def is_boundary_prompt() -> Column:
    return is_signal() & (C("intent") == "vscodePrompt")


def is_actionable() -> Column:
    """Events that count as an action: no editor switches, titles, progress notes or shown suggestions."""
    quiet = C("signal_type").isin("thread-title", "completion-shown") | C("intent").isin(*METADATA_INTENTS)
    return (C("event_type") != "editorSwitch") & ~(is_signal() & quiet)


def is_autonomous_signal() -> Column:
    intent = C("intent")
    acting = (
        is_subagent_intent(intent)
        | intent.isin("apply_patch", *EDIT_INTENTS)
        | intent.startswith("browser/")
        | (C("signal_type") == "tool-loop-stop")
    )
    return is_signal() & acting


def is_ai_execution_request() -> Column:
    return (
        is_signal() & (C("signal_type") == "chat-request") & (C("actor") == "ai") & (C("phase") == "execution")
    )


def classify(intent: Column, part: str) -> Column:
    """Actor or phase of an intent tag."""
    index = {"actor": 0, "phase": 1}[part]
    kinds = [
        (intent.isNull() | (intent == ""), ("system", "planning")),
        (intent.isin(*HUMAN_INTENTS), ("human", "human")),
        (intent.isin(*METADATA_INTENTS, "intentDetection"), ("system", "planning")),
        (intent.isin(*PLANNING_INTENTS), ("ai", "planning")),
        (intent == "tool/searchSubagentTool", ("ai", "research")),
        (is_subagent_intent(intent) | intent.isin("workspace/editfile", "apply_patch"), ("ai", "execution")),
    ]
    return choose([(condition, pair[index]) for condition, pair in kinds], "human")


def intent_name(intent: Column) -> Column:
    """Display name of a known intent, else null."""
    return choose([(intent == key, name) for key, name in INTENT_NAMES.items()], F.lit(None).cast("string"))


def acceptance_ratio(accepted: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0.0)).otherwise(F.least(accepted / total, F.lit(1.0)))


def texts() -> dict[str, Column]:
    """The raw text with whitespace collapsed and the intent in words; to be evaluated once per row."""
    return {"flat_text": text.collapse(C("raw_text")), "intent_words": text.humanise(C("intent"))}


def timeline_entry() -> dict[str, Column]:
    """How an event appears on a session timeline: actor, phase, label, detail, side and flags."""
    signal, intent, actor = C("signal_type"), C("intent"), C("actor")
    raw, model = C("raw_text"), C("model_name")
    tool = F.substr(intent, F.lit(len("browser/") + 1))
    browser = intent.startswith("browser/")
    by_actor = choose([(actor == "human", "left"), (actor == "system", "center")], "right")
    # condition, label, detail, side, accepted, autonomous
    rules = [
        (C("event_type") == "textChange", "Text change",
         F.format_string("+%d / -%d", "chars_added", "chars_deleted"), "left", C("chars_added") > 0, False),
        (C("event_type") == "completionAccept", "Completion accepted",
         text.or_else(model, F.lit("Inline completion")), "left", True, False),
        (C("event_type") == "editorSwitch", "Editor switch", C("file_path"), "left", False, False),
        (intent == "vscodePrompt", "New chat prompt", F.lit("New Chat"), "left", False, False),
        (intent == "copilotLanguageModelWrapper", "Conversation turn",
         text.or_else(model, F.lit("Chat wrapper")), "left", False, False),
        (signal == "plan-proposal", "Plan proposed", text.or_else(intent, raw),
         F.when(actor == "human", "left").otherwise("right"), False, False),
        (signal == "memory-boundary", "Memory Refreshed", intent, "center", False, False),
        (signal == "reference-used", "Reference used", text.or_else(C("flat_text"), intent), "center", False, False),
        (signal == "command-executed", "Command executed", text.or_else(C("flat_text"), intent), "right", False, True),
        (signal == "tool-loop-stop", "Autonomous loop completed", text.or_else(model, intent), "center", True, True),
        (signal == "user-choice", "User choice", raw, "left", False, False),
        (signal == "completion-shown", "Suggestion shown", model, "right", False, False),
        (intent == "apply_patch", "Apply patch", text.edit_detail(raw, C("flat_text"), intent), "right", False, True),
        (intent.isin(*EDIT_INTENTS), "Edit file", text.edit_detail(raw, C("flat_text"), intent), "right", False, True),
        (browser, choose([(tool == "navigate", "Browser navigate"), (tool == "screenshot", "Browser screenshot")],
                         "Browser research"),
         text.search_detail(raw, C("flat_text"), text.or_else(tool, F.lit("browser"))), "right", False, True),
    ]
    other_label = choose(
        [(C("phase") == "research", "Research action"), (C("phase") == "execution", "Execution action")],
        "Chat request",
    )
    pick = lambda i, default: choose([(rule[0], rule[i]) for rule in rules], default)
    editor = ~is_signal()
    shown = is_signal() & (signal == "completion-shown") & ~intent.isin(*HUMAN_INTENTS)
    return {
        "actor": choose([(editor, "human"), (shown, "ai")], actor),
        "phase": choose([(editor, "human"), (shown, "execution")], C("phase")),
        "label": pick(1, other_label),
        "detail": pick(2, text.or_else(intent, model)),
        "side": pick(3, by_actor),
        "accepted": pick(4, False),
        "is_autonomous": pick(5, is_subagent_intent(intent)),
        "is_memory_refresh": is_signal() & ~intent.isin(*HUMAN_INTENTS) & (signal == "memory-boundary"),
    }


def thought_detail() -> Column:
    """Detail of a signal that is no prompt, edit, command, reference or memory step."""
    intent, model, flat, words = C("intent"), C("model_name"), C("flat_text"), C("intent_words")
    fallback = F.when(intent != "", words).otherwise(text.humanise(C("signal_type")))
    browsing = (C("phase") == "research") & intent.startswith("browser/")
    return choose(
        [
            (browsing, text.search_detail(C("raw_text"), flat, words)),
            ((C("phase") != "research") & (intent == "") & (model != ""), model),
        ],
        text.detail(flat, fallback),
    )


def is_agent_step() -> Column:
    """Signals that appear as a step of the agent."""
    silent = C("signal_type").isin("thread-title", "completion-shown", "tool-loop-stop")
    return is_signal() & ~silent & ~C("intent").isin(*METADATA_INTENTS)


def agent_step() -> dict[str, Column]:
    """Label, detail and fallback flag of the agent step a signal stands for."""
    signal, intent, actor, phase, raw = C("signal_type"), C("intent"), C("actor"), C("phase"), C("raw_text")
    flat, words = C("flat_text"), C("intent_words")
    edit = intent.isin("apply_patch", *EDIT_INTENTS)
    command = (intent == "terminal/runCommand") | (signal == "command-executed")
    reference = signal == "reference-used"
    browsing = (phase == "research") & intent.startswith("browser/")
    search = browsing | (intent == "tool/searchSubagentTool")
    memory = signal == "memory-boundary"
    planned = (signal == "plan-proposal") | intent.isin(*PLANNING_INTENTS)
    label = choose(
        [
            (intent == "vscodePrompt", "Prompt"), (edit, "Updated"), (command, "Executed"), (reference, "Used reference"),
            (search, "Searched"), (memory, "Memory file"),
            ((actor == "ai") & (phase == "planning"), F.when(planned, "Considered").otherwise("Evaluating")),
            (actor == "ai", "Thought"),
        ],
        "Activity",
    )
    named = label.isin("Thought", "Activity", "Considered", "Evaluating")
    # What the collapsed text is replaced by where it is empty.
    source = text.humanise(text.or_else(F.regexp_replace(intent, r"\Areference/", ""), F.lit("reference")))
    fallback = choose(
        [(command, "Run command"), (reference, source), (intent == "tool/searchSubagentTool", "Search request"),
         (memory, "Memory file")],
        words,
    )
    detail = choose(
        [
            (intent == "vscodePrompt", F.coalesce(text.prompt_title(raw), F.lit("Prompt"))),
            (edit, text.edit_detail(raw, flat, words)),
            (~command & ~reference & browsing, text.search_detail(raw, flat, words)),
            (~command & ~reference & ~search & memory & (intent != ""), words),
            (command | reference | search | memory, text.detail(flat, fallback)),
        ],
        thought_detail(),
    )
    return {"label": label, "detail": detail, "is_fallback": named & ~((actor == "ai") & (phase == "planning"))}


# Fixed patterns: tool names and the step they stand for (first match wins).
TOOL_STEPS = [
    (r"apply_patch|workspace/editfile|editfile|edit-file", "Updated", "ai", "execution"),
    (r"terminal|runinterminal|runcommand|exec|command", "Executed", "ai", "execution"),
    (r"search|browser|navigate|grep|find|fetch|web", "Searched", "ai", "research"),
    (r"compact|memory|context_limit|summarize", "Memory file", "system", "memory"),
    (r"reference|context", "Used reference", "system", "research"),
]


def tool_step(name: Column) -> Column:
    """Struct (label, actor, phase, is_fallback) for a tool call."""
    lower = F.lower(name)
    pick = lambda i, default: choose([(lower.rlike(rule[0]), rule[i]) for rule in TOOL_STEPS], default)
    return F.struct(
        pick(1, "Thought").alias("label"),
        pick(2, "ai").alias("actor"),
        pick(3, "execution").alias("phase"),
        (~lower.rlike("|".join(rule[0] for rule in TOOL_STEPS))).alias("is_fallback"),
    )
