"""Expressions that shape records: status texts, envelopes, defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a status code says to the user, and the colour of a notification.
STATUS_TEXTS = {
    200: ("Action completed successfully", ""),
    400: ("Action returned a bad request", "please check the console for more details"),
    500: ("Internal server error", "please check the console for more details"),
}
OTHER_STATUS = ("Something went wrong", "please check the console for more details")
SEVERITY_COLOURS = {"error": "red", "success": "green", "loading": "yellow", "update": "blue"}


def _status(status: Column, part: int) -> Column:
    out = F.when(F.coalesce(status, F.lit(0)) == 0, F.lit(None).cast("string"))  # no status says nothing
    for code, texts in STATUS_TEXTS.items():
        out = out.when(status == code, texts[part])
    return out.otherwise(OTHER_STATUS[part])


def status_title(status: Column) -> Column:
    return _status(status, 0)


def status_message(status: Column) -> Column:
    return _status(status, 1)


def severity_colour(severity: Column) -> Column:
    """The colour of a severity, null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in SEVERITY_COLOURS.items() for x in kv)), severity)


def text_after_last(text: Column, delimiter: str) -> Column:
    """The text after the last delimiter, the whole text without one."""
    return F.substring_index(text, delimiter, -1)


def nth_word(text: Column, n: int) -> Column:
    """Word ``n`` (from 0) of the trimmed text, cut at single spaces; null out of range."""
    return F.get(F.split(F.trim(text), " "), F.lit(n))


def default_value(value: Column, default: Column) -> Column:
    """``default`` where the value is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def is_ready(reply: Column) -> Column:
    """Whether a polled reply does not report an error; null is no text, hence ready."""
    return ~F.coalesce(F.contains(reply, F.lit("Error")), F.lit(False))


def envelope(message: Column, data: Column) -> Column:
    """``{"message", "data"}`` as JSON; a null data field is left out."""
    return F.to_json(F.struct(message.alias("message"), data.alias("data")))


def error_envelope(message: Column, error: Column) -> Column:
    return F.to_json(F.struct(message.alias("message"), error.alias("error")))
