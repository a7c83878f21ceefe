"""String helpers as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROMPT_TITLE_CHARS = 80
DETAIL_CHARS = 96
PREVIEW_CHARS = 160

# Prompt-length buckets (label, longest length, midpoint used on the x axis).
PROMPT_BUCKETS = [("0-50", 50, 25), ("51-100", 100, 75), ("101-200", 200, 150), ("201+", None, 300)]

# Texts that carry no prompt of their own.
EMPTY_PROMPTS = ["vscodeprompt", "copilotlanguagemodelwrapper", "chat-request", "text change"]



def evaluate_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row.

    A one-row generator keeps the optimizer from substituting their definitions into every later use (a filter on a
    column that depends on several others would otherwise grow exponentially when it is pushed down).
    """
    return df.select("*", F.inline(F.array(F.struct(*[value.alias(name) for name, value in columns.items()]))))


# Fixed pattern: what counts as whitespace, Unicode spaces included.
SPACE = r"\s\x0B\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"


def strip(text: Column) -> Column:
    """Remove surrounding whitespace."""
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def collapse(text: Column) -> Column:
    """Runs of whitespace become one space, none at the ends."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def or_else(text: Column, fallback: Column) -> Column:
    """`fallback` where the text is null or empty."""
    return F.when(F.coalesce(text, F.lit("")) == "", fallback).otherwise(text)


def shorten(text: Column, limit: int) -> Column:
    """At most `limit` characters, the last one an ellipsis if something was cut."""
    cut = F.concat(F.rtrim(F.substring(text, 1, limit - 1)), F.lit("…"))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def truncate_title(text: Column) -> Column:
    cut = F.concat(F.substring(text, 1, PROMPT_TITLE_CHARS), F.lit("…"))
    return F.when(F.length(text) > PROMPT_TITLE_CHARS, cut).otherwise(text)


def detail(flat: Column, fallback: Column) -> Column:
    """Whitespace-collapsed text, or the fallback, cut to the length of a detail."""
    return shorten(or_else(flat, fallback), DETAIL_CHARS)


def preview(text: Column) -> Column:
    return F.substring(collapse(text), 1, PREVIEW_CHARS)


def normalize_model(model: Column) -> Column:
    """Base model name without deployment alias, version, hash and vendor suffix."""
    base = strip(F.substring_index(model, " -> ", 1))
    for separator in (":", "#"):
        base = strip(F.regexp_replace(base, rf"(?s)\A([^{separator}]+){separator}.*\z", "$1"))
    return strip(F.regexp_replace(base, r"(?i)-copilot\z", ""))


def prompt_title(raw: Column) -> Column:
    """Readable prompt from a raw log text; null if nothing but boilerplate is left."""
    text = F.regexp_replace(raw, f"[{SPACE}]+", " ")
    # Fixed patterns: leading timestamp with level, request prefix, trailing tag, quotes.
    for pattern in (
        r"(?i)\A\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)?(?:\s*\[[^\]]+\])?\s*",
        r"(?i)\Accreq:[^|]+\|\s*success\s*\|\s*[^|]+\|\s*\d+ms\s*\|\s*",
        r"\[[^\]]+\]\s*\z",
        r"\A['\"`]+|['\"`]+\z",
    ):
        text = F.regexp_replace(text, pattern, "")
    text = F.trim(text)
    empty = (text == "") | F.lower(text).isin(*EMPTY_PROMPTS)
    return F.when(~empty, F.substring(text, 1, PROMPT_TITLE_CHARS))


def humanise(intent: Column) -> Column:
    words = F.regexp_replace(intent, r"\Atool/", "")
    words = F.regexp_replace(words, r"\Abrowser/", "browser ")
    words = F.regexp_replace(words, r"\Areference/", "reference ")
    return or_else(F.trim(F.regexp_replace(words, r"[/_-]+", " ")), F.when(intent == "", "Activity").otherwise(F.lit("")))


def edit_detail(raw: Column, flat: Column, fallback: Column) -> Column:
    """File or patch target named in a raw text, else its whitespace-collapsed form `flat`."""
    file = F.regexp_extract(raw, r"(?i)workspace/editfile\s+(\S+)", 1)
    patched = strip(F.regexp_extract(raw, r"(?i)apply_patch(?:\s+to\s+file)?\s+(\S.*)\z", 1))
    return F.when(file != "", file).when(patched != "", patched).otherwise(or_else(flat, fallback))


def search_detail(raw: Column, flat: Column, fallback: Column) -> Column:
    target = F.regexp_extract(raw, r"(?i)browser[_-]navigate\s+(\S+)", 1)
    return F.when(target != "", target).otherwise(or_else(flat, fallback))


def prompt_bucket(length: Column) -> Column:
    bucket = F.lit(PROMPT_BUCKETS[-1][0])
    for label, longest, _ in reversed(PROMPT_BUCKETS[:-1]):
        bucket = F.when(length <= longest, F.lit(label)).otherwise(bucket)
    return bucket


def agent_name(uri: Column) -> Column:
    """Last segment of an agent URI; null for the built-in agent."""
    parts = F.filter(F.split(strip(uri), "[/:#]"), lambda p: p != "")
    name = F.coalesce(F.try_element_at(parts, F.lit(-1)), strip(uri))
    return F.when((strip(uri) != "") & (name != "agent"), name)


def basename(path: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(path, r"/+\z", ""), "/"), -1)
    return F.when(path.isNull() | (path == ""), F.lit("Unknown")).otherwise(or_else(last, path))


def duration_text(ms: Column) -> Column:
    """Milliseconds as `2h 5m 30s`."""
    seconds = F.round(ms / 1000).cast("long")
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return (
        F.when(hours > 0, F.format_string("%dh %dm %ds", hours, minutes, rest))
        .when(minutes > 0, F.format_string("%dm %ds", minutes, rest))
        .otherwise(F.format_string("%ds", rest))
    )


def share_text(value: Column, total: Column) -> Column:
    percent = value / total * 100
    digits = F.regexp_replace(F.format_number(percent, 2), r"\.?0+\z", "")
    return (
        F.when(value.isNull() | total.isNull() | (total <= 0), "Unavailable")
        .when((percent > 0) & (percent < 0.01), "<0.01%")
        .otherwise(F.concat(digits, F.lit("%")))
    )


def credits(nano: Column) -> Column:
    """Credits from nano-credits; unknown stays unknown."""
    return nano.cast("double") / F.lit(1_000_000_000)


def spreadsheet_safe(text: Column) -> Column:
    """Keep spreadsheet programs from evaluating a text as a formula."""
    return F.when(text.rlike(r"\A[\t\r\n]|\A\s*[=+@-]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_field(text: Column) -> Column:
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\n]'), quoted).otherwise(text)


def markdown_safe(text: Column) -> Column:
    """Escape the characters that would format or break a Markdown table cell."""
    escaped = F.replace(text, F.lit("&"), F.lit("&#38;"))
    for char in "<>|`*_[]\\":
        escaped = F.replace(escaped, F.lit(char), F.lit(f"&#{ord(char)};"))
    return F.regexp_replace(escaped, r"[\r\n]", " ")


def iso_text(timestamp: Column) -> Column:
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def flexible_timestamp(text: Column) -> Column:
    """Timestamp from epoch-millisecond digits or from ISO text; null if neither."""
    trimmed = strip(text)
    digits = trimmed.rlike(r"\A\d+\z")
    return F.when(digits, F.timestamp_millis(F.when(digits, trimmed).cast("long"))).otherwise(
        F.try_to_timestamp(trimmed)
    )


def strict_timestamp(text: Column) -> Column:
    """ISO timestamp that starts with a full date and `T`; null otherwise."""
    return F.when(text.rlike(r"\A\d{4}-\d{2}-\d{2}T"), F.try_to_timestamp(text))


def label(text: Column) -> Column:
    """Identifier of at most 200 safe characters, else null."""
    return F.when(text.rlike(r"\A[\w.:-]{1,200}\z"), text)
