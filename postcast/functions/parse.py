"""Parsing of model responses held in a text column.

Valid JSON that is not an array gives an empty list without trying a fenced
block; for comments, invalid JSON falls back to the first fenced block; items
need the required keys present (null values pass)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed value: the fenced block of a reply
FENCED_ARRAY = r"(?s)```(?:json)?\s*(\[.*?\])\s*```"
_ITEMS = "array<map<string,string>>"


def json_items(text: Column, required: list[str], fenced_too: bool = True) -> Column:
    parsed = F.try_parse_json(text)
    arr = F.try_variant_get(parsed, "$", _ITEMS)
    if fenced_too:
        fenced = F.try_parse_json(F.nullif(F.regexp_extract(text, FENCED_ARRAY, 1), F.lit("")))
        arr = F.when(parsed.isNotNull(), arr).otherwise(F.try_variant_get(fenced, "$", _ITEMS))
    arr = F.coalesce(arr, F.array().cast(_ITEMS))

    def has_all(m):
        cond = F.lit(True)
        for k in required:
            cond = cond & F.map_contains_key(m, k)
        return cond
    return F.filter(arr, has_all)


def comment_items(text: Column) -> Column:
    """Items with username and comment."""
    return json_items(text, ["username", "comment"])


def suggestion_items(text: Column) -> Column:
    """Items with title; the text as a whole has to be the array."""
    return json_items(text, ["title"], fenced_too=False)
