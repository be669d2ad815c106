"""Text and JSON column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeops.functions.common import col


def json_type(text: Column | str) -> Column:
    """Kind of a JSON value, told from its first character; NULL for other text."""
    head = F.substring(F.trim(col(text)), 1, 1)
    return (
        F.when(head == "[", "array")
        .when(head == "{", "object")
        .when(head == '"', "string")
        .when(head.isin("t", "f"), "boolean")
        .when(head == "n", "null")
        .when(head.rlike("[-0-9]"), "number")
    )
