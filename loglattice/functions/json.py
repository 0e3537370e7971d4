"""JSON texts put together from columns, as the collector writes them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    whole = F.to_json(F.array(text))
    return F.substr(whole, F.lit(2), F.length(whole) - 2)


def number(value: Column) -> Column:
    """A finite double as a JSON number in plain digits, without a fraction of zeros; beyond 28 digits as it is."""
    digits = F.regexp_replace(F.regexp_replace(value.try_cast("decimal(38, 9)").cast("string"), r"(\.\d*?)0+\z", "$1"), r"\.\z", "")
    return F.coalesce(digits, value.cast("string"))


def escaped(json: Column) -> Column:
    """JSON with <, > and & written as \\u escapes."""
    for char, code in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        json = F.replace(json, F.lit(char), F.lit(code))
    return json
