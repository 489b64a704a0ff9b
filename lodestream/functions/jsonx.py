"""JSON inside free text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCE = re.compile(r"^\s*```(?:json)?\s*\n?(.*?)\n?\s*```\s*$", re.S | re.I)


def _load(text: str) -> dict | None:
    try:
        v = json.loads(text)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


_DECODER = json.JSONDecoder()


def _object_at(text: str, start: int) -> dict | None:
    """The object that begins at the brace at ``start``, whatever follows it."""
    try:
        return _DECODER.raw_decode(text, start)[0]
    except (ValueError, RecursionError):
        return None


def object_in(text: str | None, retry: bool = False) -> str | None:
    """The whole text as an object, else the object at its first brace, as canonical JSON; ``retry`` goes on to later braces."""
    if not text:
        return None
    fenced = _FENCE.match(text)
    body = fenced[1] if fenced else text
    found = _load(body.strip())
    at = body.find("{")
    while found is None and at >= 0:
        found = _object_at(body, at)
        at = body.find("{", at + 1) if retry else -1
    return None if found is None else json.dumps(found, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


@F.pandas_udf(StringType())
def first_object(s: pd.Series) -> pd.Series:
    """First JSON object of a text, canonical; null if there is none."""
    return s.map(object_in)


@F.pandas_udf(StringType())
def any_object(s: pd.Series) -> pd.Series:
    """First slice of a text that is a JSON object, canonical; null if there is none."""
    return s.map(lambda t: object_in(t, retry=True))


@F.pandas_udf(StringType())
def strict_object(s: pd.Series) -> pd.Series:
    """A text that is one JSON object and nothing else, canonical; else null."""
    return s.map(lambda t: None if t is None or (v := _load(t.strip())) is None else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def json_equal(a: Column, b: Column) -> Column:
    """Whether two JSON texts are equal, whatever the order of keys; invalid texts equal nothing."""
    return F.coalesce(F.to_json(F.try_parse_json(a)) == F.to_json(F.try_parse_json(b)), F.lit(False))


def compact(col: Column) -> Column:
    """A struct as JSON with its nulls and in its order of fields."""
    return F.to_json(col, {"ignoreNullFields": "false"})
