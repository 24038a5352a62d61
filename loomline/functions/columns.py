"""Column functions of the transcript model. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space as JavaScript's \s has it.
SPACE = r"[\s\x0B   -     　﻿]"
# Bare acknowledgments, shell commands and marks of injected turns.
ACKNOWLEDGMENTS = "yes|yep|yeah|ok|okay|sure|sounds good|looks good|lgtm|great|thanks|thank you|perfect|continue|go ahead|do it|proceed|approved?|good|nice|cool"
COMMANDS = "npm|git|curl|cd|ls|cat|grep|sed|awk|python3?|node|rm|mkdir"
INJECTED = r"<task-notification>|<system-reminder>|\[SYSTEM NOTIFICATION\b"
# Themes of flagged directives and their patterns, first match wins.
THEMES = (
    ("manual-testing", r"(?i)\b(ran|running|wrote|added) tests?\b|manually ran"),
    ("manual-code-review", r"(?i)\bcode review\b|specified exact fixes|manually performed (the )?(code )?review"),
    ("redundant-order", r"(?i)\balready\b.*\b(doing|proceeding|following|said)\b|redundant"),
    ("procedural-instruction", r"(?i)\btold agent\b|\binstructed\b|imperative"),
)
# Beginnings of scratch directories.
TEMP_PREFIXES = ("/tmp/", "/private/tmp", "-private-tmp", "-tmp-")
TEMP_PATTERN = r"^/private/var/folders/.*/T/|^-private-var-folders-.*-T-"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def trim(text: Column) -> Column:
    """Without white space, as JavaScript sees it, at both ends."""
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all else as it is: the case rule of LIKE."""
    return F.translate(text, UPPER, LOWER)


def like_folded(text: Column, query: str) -> Column:
    """ASCII-case-insensitive containment; % and _ in the query are wildcards."""
    folded = query.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return ascii_lower(text).like(f"%{folded}%")


def local_date(ts: Column, tz: str = "UTC") -> Column:
    """The day of an instant in a zone, as YYYY-MM-DD."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(tz), ts.cast("timestamp_ntz")), "yyyy-MM-dd")


def asked_question(text: Column) -> Column:
    """A line that ends in a question mark, or one that begins with options: or choices:."""
    return trim(text).rlike(rf"(?im)\?{SPACE}*$|^{SPACE}*(?:options?|choices?){SPACE}*:")


def is_injected(text: Column) -> Column:
    return text.rlike(rf"(?i)^{SPACE}*(?:{INJECTED})")


def is_acknowledgment(text: Column) -> Column:
    """Under 15 tokens and nothing but acknowledgments, with or without separators."""
    t = trim(text)
    return (F.size(F.split(t, f"{SPACE}+")) < 15) & t.rlike(rf"(?i)^(?:(?:{ACKNOWLEDGMENTS})(?:[.,!]|{SPACE})*)+$")


def directive_hint(text: Column) -> Column:
    """A code fence, or a line that looks like a shell command."""
    return text.contains("```") | text.rlike(rf"(?im)^{SPACE}*[$#]?{SPACE}*(?:{COMMANDS}){SPACE}")


def token_estimate(chars: Column) -> Column:
    return F.ceil(chars / 4)


def ratio(part: Column, total: Column) -> Column:
    """part / total, 0 for an empty total."""
    return F.when(total > 0, part / total).otherwise(F.lit(0.0))


def ratio_or_null(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total)


def is_temp_path(path: Column) -> Column:
    starts = F.lit(False)
    for p in TEMP_PREFIXES:
        starts = starts | path.startswith(p)
    return starts | path.rlike(TEMP_PATTERN)


def theme(reason: Column) -> Column:
    chosen = None
    for name, pattern in THEMES:
        chosen = F.when(reason.rlike(pattern), name) if chosen is None else chosen.when(reason.rlike(pattern), name)
    return chosen.otherwise("other")


def elapsed_days(first: Column, last: Column) -> Column:
    return F.datediff(last.cast("date"), first.cast("date"))


def relative_time(then: Column, now: Column) -> Column:
    """Rounded age in minutes, hours or days."""
    half_up = lambda c: F.floor(c + 0.5).cast("long")
    mins = half_up((F.unix_micros(now) - F.unix_micros(then)) / 60e6)
    hours = half_up(mins / 60)
    ago = lambda n, unit: F.concat(n.cast("string"), F.lit(unit + " ago"))
    return F.when(then.isNull(), "—").when(mins < 1, "just now").when(mins < 60, ago(mins, "m")).when(hours < 24, ago(hours, "h")).otherwise(ago(half_up(hours / 24), "d"))


# JSON messages, as VARIANT


def _text(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "string")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def content_blocks(raw: Column) -> Column:
    """The blocks of message.content if it is an array, else null."""
    return F.try_variant_get(raw, "$.message.content", "array<variant>")


def content_string(raw: Column) -> Column:
    """message.content if it is a string, else null."""
    v = F.try_variant_get(raw, "$.message.content", "variant")
    return F.when(_kind(v) == "STRING", _text(raw, "$.message.content"))


def has_block(raw: Column, kind: str) -> Column:
    return F.coalesce(F.exists(content_blocks(raw), lambda b: F.coalesce(_text(b, "$.type") == kind, F.lit(False))), F.lit(False))


def flag_is_true(raw: Column, name: str) -> Column:
    """Whether a field holds the JSON value true; the text "true" does not count."""
    v = F.try_variant_get(raw, f"$.{name}", "variant")
    return F.coalesce((_kind(v) == "BOOLEAN") & F.try_variant_get(raw, f"$.{name}", "boolean"), F.lit(False))


def render_content(raw: Column) -> Column:
    """A message as plain text: strings as they are; text, tool-use and tool-result blocks line by line."""

    def result_text(b: Column) -> Column:
        items = F.try_variant_get(b, "$.content", "array<variant>")
        texts = F.transform(F.filter(items, lambda i: F.coalesce(_text(i, "$.type") == "text", F.lit(False)) & _text(i, "$.text").isNotNull()), lambda i: _text(i, "$.text"))
        whole = F.when(_kind(F.try_variant_get(b, "$.content", "variant")) == "STRING", _text(b, "$.content"))
        return F.coalesce(F.array_join(texts, " "), whole, F.lit(""))

    def block(b: Column) -> Column:
        kind = _text(b, "$.type")
        used = F.concat(F.lit("[tool_use: "), _text(b, "$.name"), F.lit("] "), F.to_json(F.try_variant_get(b, "$.input", "variant")))
        result = result_text(b)
        return F.when(kind == "text", _text(b, "$.text")).when(kind == "tool_use", used).when((kind == "tool_result") & (result != ""), F.concat(F.lit("[tool_result] "), result))

    blocks = F.filter(F.transform(content_blocks(raw), block), lambda t: t.isNotNull())
    return F.coalesce(content_string(raw), F.array_join(blocks, "\n"), F.lit(""))


def has_text(raw: Column) -> Column:
    """A non-empty string, or any text block, even an empty one."""
    return F.coalesce(F.length(content_string(raw)) > 0, F.lit(False)) | has_block(raw, "text")
