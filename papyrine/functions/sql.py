"""The rules as SQL functions: scalar ones as temporary SQL functions, findings as table functions over partitioned tables.

After register(spark) a query in SQL alone can call them:

    SELECT has_metric(text), metric_phrase(text) FROM statements
    SELECT * FROM timeline_gaps(TABLE(posts) PARTITION BY owner ORDER BY (start, `end`))
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import Row

from papyrine.operators import entries, reports, statements, wording


def _raw(pattern: str) -> str:
    """A pattern as a raw string literal of SQL."""
    if '"' not in pattern:
        return f'r"{pattern}"'
    if "'" not in pattern:
        return f"r'{pattern}'"
    raise ValueError("patterns with both kinds of quotes have no raw literal")


#: Name, parameters, type and body of scalar functions.
SCALARS = {
    "has_metric": ("text STRING", "BOOLEAN", f"coalesce(text, '') RLIKE {_raw(statements.METRIC)}"),
    "has_outcome": ("text STRING", "BOOLEAN", f"coalesce(text, '') RLIKE {_raw(statements.METRIC)} OR coalesce(text, '') RLIKE {_raw(statements.OUTCOME)}"),
    "n_vague": ("text STRING", "BIGINT", f"regexp_count(coalesce(text, ''), {_raw(statements.VAGUE)})"),
    "weak_opener": ("text STRING", "BOOLEAN", f"coalesce(text, '') RLIKE {_raw(statements.WEAK_OPENERS)}"),
    "is_passive": ("text STRING", "BOOLEAN", f"coalesce(text, '') RLIKE {_raw(wording.PASSIVE)}"),
    "verb_tier": ("text STRING", "INT", f"CASE WHEN trim(text) RLIKE {_raw(wording.HIDING)} THEN 3 WHEN lower(regexp_extract(text, r'[A-Za-z][A-Za-z0-9_-]*', 0)) IN ({', '.join(repr(v) for v in wording.STRONG)}) THEN 1 ELSE 2 END"),
    "found_dates": ("text STRING", "STRING", f"CASE WHEN regexp_extract(text, {_raw(entries.RANGE)}, 1) <> '' THEN concat(regexp_extract(text, {_raw(entries.RANGE)}, 1), ' – ', regexp_extract(text, {_raw(entries.RANGE)}, 2)) ELSE regexp_extract(text, {_raw(entries.SINGLE)}, 1) END"),
    "calibrated": ("cosine DOUBLE, low DOUBLE, high DOUBLE", "DOUBLE", "greatest(0.0D, least(1.0D, try_divide(cosine - low, high - low)))"),
}


class TimelineGaps:
    """Stretches of least or more between one owner's merged intervals. Rows must be partitioned by owner and ordered by start, end.

    An interval without start or end is left out. Only the end reached so far is kept, so an owner may have any number of rows.
    """

    def __init__(self) -> None:
        self.end: int | None = None

    def eval(self, row: Row, least: int = 1) -> Iterator[tuple]:
        start, end = row["start"], row["end"]
        if start is None or end is None:
            return
        if self.end is not None and start - self.end - 1 >= least:
            yield row["owner"], self.end + 1, start - 1, start - self.end - 1
        self.end = end if self.end is None else max(self.end, end)


class SignalFindings:
    """The signals of reports.SIGNALS in rows with doc_id and text: how often each is found, and its first hit."""

    def __init__(self) -> None:
        import re

        self.patterns = {name: re.compile(pattern) for name, pattern in reports.SIGNALS.items()}

    def eval(self, row: Row) -> Iterator[tuple]:
        for name, pattern in self.patterns.items():
            hits = [m.group(0) for m in pattern.finditer(row["text"] or "")]
            if hits and hits[0]:
                yield row["doc_id"], name, len(hits), hits[0]


TABLES = {
    "timeline_gaps": (TimelineGaps, "owner bigint, gap_from bigint, gap_to bigint, length bigint"),
    "signal_findings": (SignalFindings, "doc_id bigint, signal string, n bigint, first string"),
}


def register(spark: SparkSession) -> list[str]:
    """Makes all functions known to the session; returns their names. It can be called again."""
    for name, (parameters, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, (handler, kind) in TABLES.items():
        spark.udtf.register(name, udtf(handler, returnType=kind))
    return [*SCALARS, *TABLES]
