"""Conversations: extraction, folding, pairing, conversion and tool calls."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURNS = "array<struct<from:string,value:string>>"
HUMAN, MODEL = ("human", "user"), ("gpt", "assistant")


def question_answer(turns: Column) -> tuple[Column, Column]:
    """First non-blank human turn, and the first model turn after it even if blank; without outer white space."""
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")
    marked = F.transform(turns, lambda t, i: F.struct(t["from"].alias("from"), strip(t["value"]).alias("value"), i.alias("i")))
    q = F.try_element_at(F.filter(marked, lambda t: t["from"].isin(*HUMAN) & (t["value"] != "")), F.lit(1))
    a = F.try_element_at(F.filter(marked, lambda t: t["from"].isin(*MODEL) & (t["i"] > q["i"])), F.lit(1))
    return q["value"], a["value"]


def first_turn(turns: Column, roles: tuple[str, ...]) -> Column:
    """Text of the first turn of a role, which may be empty."""
    return F.try_element_at(F.filter(turns, lambda t: t["from"].isin(*roles)), F.lit(1))["value"]


def two_turns(question: Column, answer: Column) -> Column:
    """A conversation of one question and one answer."""
    return F.array(F.struct(F.lit("human").alias("from"), question.alias("value")), F.struct(F.lit("gpt").alias("from"), answer.alias("value")))


def alpaca(instruction: Column, text: Column, output: Column) -> Column:
    """instruction, and input after a blank line unless it is blank, against output."""
    more = F.when(F.trim(F.coalesce(text, F.lit(""))) != "", F.concat(instruction, F.lit("\n\n"), text)).otherwise(instruction)
    return two_turns(more, output)


def folded_history(turns: Column) -> Column:
    """Array of (user, assistant): consecutive user turns joined by a line break, each with the next assistant turn; orphan
    assistant turns and a trailing user turn are left out."""
    start = F.struct(F.lit(None).cast("string").alias("open"), F.array().cast("array<struct<user:string,assistant:string>>").alias("done"))

    def step(acc: Column, t: Column) -> Column:
        user = t["from"].isin(*HUMAN)
        model = t["from"].isin(*MODEL) & acc["open"].isNotNull()
        pair = F.struct(acc["open"].alias("user"), t["value"].alias("assistant"))
        return F.struct(
            F.when(user, F.when(acc["open"].isNull(), t["value"]).otherwise(F.concat(acc["open"], F.lit("\n"), t["value"]))).when(~model, acc["open"]).alias("open"),
            F.when(model, F.concat(acc["done"], F.array(pair))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(turns, start, step, lambda acc: acc["done"])


def last_user(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """Each model turn of a flat turn table with the latest user text before it (null if there is none)."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    asked = F.last(F.when(F.col(role).isin(*HUMAN), F.col(text)), ignorenulls=True).over(w)
    return df.withColumn("user_text", asked).where(F.col(role).isin(*MODEL))


def conversation_issue(raw: Column) -> Column:
    """Why a JSON line is no conversation, or valid: not_json, no_conversations, missing_fields, unknown_role."""
    v = F.from_json(raw, f"struct<conversations:{TURNS}>")
    c = v["conversations"]
    return (
        F.when(F.try_parse_json(raw).isNull(), "not_json").when(c.isNull() | (F.size(c) == 0), "no_conversations")
        .when(F.exists(c, lambda t: t["from"].isNull() | t["value"].isNull()), "missing_fields").when(F.exists(c, lambda t: ~t["from"].isin("human", "gpt", "system")), "unknown_role").otherwise("valid")
    )


def rendered(history: Column, system: Column, prompt: str = "{query}", sep: str = "\n") -> Column:
    """A folded history in a template: system text once, then each user turn in ``prompt`` and its answer."""
    head, tail = prompt.split("{query}")
    turns = F.transform(history, lambda h: F.concat(F.lit(head), h["user"], F.lit(tail), F.coalesce(h["assistant"], F.lit(""))))
    return F.concat_ws(sep, F.when(system != "", system), F.array_join(turns, sep))


def length_within(prompt: Column, answer: Column, most: int) -> Column:
    """Characters of prompt and answer together lie in 1 to ``most``."""
    return (F.length(prompt) + F.length(answer)).between(1, most)


_CALL = re.compile(r"<tool_call>\s*(.*?)\s*</tool_call>", re.S)
_DECODER = json.JSONDecoder()
TOOL_CALLS = "array<struct<name:string,arguments:string>>"


def _dumped(value: object) -> str:
    return json.dumps(value, ensure_ascii=False)


def _actions(text: str) -> list[dict]:
    """Calls in blocks of a line ``Action: name`` and a line ``Action Input: JSON``; the JSON may stand in quotes or a code fence."""
    out = []
    for block in text.split("Action:")[1:]:
        name, found, given = block.partition("Action Input:")
        name = name.strip()
        if not found or not re.fullmatch(r"[\w-]+", name, re.A):
            continue
        given = given.strip().strip('"`')
        value, _ = _DECODER.raw_decode(given.removeprefix("json").lstrip())
        out.append({"name": name, "arguments": _dumped(value)})
    return out


def calls_in(text: str | None, style: str) -> list[dict] | None:
    """Tool calls of a text in order; null if there are none or one is not valid JSON (the text is then plain)."""
    try:
        if style == "tags":
            found = [json.loads(x) for x in _CALL.findall(text or "")]
            out = [{"name": x["name"], "arguments": _dumped(x["arguments"])} for x in found]
        elif style == "action":
            out = _actions(text or "")
        else:
            got = json.loads(text or "null")
            out = [{"name": x["name"], "arguments": _dumped(x.get("parameters", x.get("arguments")))} for x in (got if isinstance(got, list) else [got])]
    except (ValueError, KeyError, TypeError, AttributeError):
        return None
    return out or None


def tool_calls(style: str):  # noqa: ANN201
    """Column function: tool calls of a text in one of the styles tags, action and json."""

    @F.pandas_udf(TOOL_CALLS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: calls_in(t, style))

    return run
