"""Expressions over server log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values, in order of precedence: what a line of each class contains.
LINE_CLASSES = [
    ("error", "Error"),
    ("warning", "Warning"),
    ("port", "Server is listening on port"),
    ("nodemon", "[nodemon]"),
    ("webpack", "[webpack]"),
    ("http", "[HTTP Request]"),
    ("starting", "[Starting]"),
]
OTHER_LINES = "success"


def strip_prefix(line: Column) -> Column:
    """The line without one leading ``[digits]``."""
    return F.regexp_replace(line, r"^\[[0-9]+\]", "")


def classify_line(line: Column) -> Column:
    """The first class whose text the line contains, by case; others are successes."""
    out = None
    for name, text in LINE_CLASSES:
        out = (F if out is None else out).when(F.contains(line, F.lit(text)), name)
    return out.otherwise(OTHER_LINES)


def line_port(line: Column) -> Column:
    """The digits of the last ``port <digits>`` of the line, empty without one."""
    return F.regexp_extract(line, r".*port ([0-9]*).*", 1)
