"""Guards for ad-hoc SQL."""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession


def limited(sql: str, rows: int = 20) -> str:
    """The statement with a LIMIT, unless it has one or only counts."""
    bare = sql.strip().rstrip(";")
    if re.search(r"\blimit\b", bare, re.IGNORECASE) or re.match(r"select\s+count", bare, re.IGNORECASE):
        return bare
    return f"{bare} LIMIT {rows}"


def run_select(spark: SparkSession, sql: str, rows: int = 20) -> str:
    """Result rows of a SELECT as JSON; an error, and any other kind of statement, as a JSON error."""
    if not re.match(r"\s*(select|with)\b", sql, re.IGNORECASE):
        return json.dumps({"error": "only SELECT statements are allowed"})
    try:
        return json.dumps([json.loads(x) for x in spark.sql(limited(sql, rows)).toJSON().collect()])  # limited rows
    except Exception as error:  # noqa: BLE001  the caller gets the message
        return json.dumps({"error": str(error).splitlines()[0]})
