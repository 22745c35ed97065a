"""SQL texts with positional parameters. The dialect is Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: What a question mark inside is no parameter: quoted texts, quoted names, comments.
_QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/""", re.S)


def parameter_count(text: str) -> int:
    return _QUOTED.sub(" ", text).count("?")


def run_query(spark: SparkSession, text: str, params: Sequence | None = None) -> DataFrame:
    """The rows of one statement. Parameters are bound by Spark, so they can't change the
    statement; missing and surplus ones raise ``ValueError``."""
    params = list(params or [])
    wanted = parameter_count(text)
    if wanted != len(params):
        raise ValueError(f"the statement has {wanted} parameters, {len(params)} were given")
    return spark.sql(text, args=params) if params else spark.sql(text)


def run_queries(spark: SparkSession, texts: Sequence[str]) -> list[DataFrame]:
    """The result of each statement in order; a trailing semicolon is allowed."""
    return [run_query(spark, re.sub(r";\s*\Z", "", text)) for text in texts]
