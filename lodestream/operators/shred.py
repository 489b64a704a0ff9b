"""Deeply nested JSON records into related flat tables by shared inlining.

The schema graph of a JSON column is analysed over all its rows, then
* singleton descendants are inlined into the row of their nearest repeated ancestor,
* every element that repeats in some row, is shared by several levels or contains itself gets a table of its own,
* every row of a table carries its parent's id as foreign key.

Shapes may vary from record to record: a list may be a single value, JSON text or delimited text, and a level may be
wrapped once more (``x`` against ``x.items`` or ``x.result``). A level whose keys resemble those of its parent is
taken for the parent's own level.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict, deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.session import materialize, spread

NODES = "doc_key bigint, table_name string, node_id string, parent_table string, parent_id string, ord int, fields map<string,string>"
DELIMITERS = re.compile(r"[,;|，；、\s]+")
TOKEN = re.compile(r"[\w.:#/-]{1,64}")
#: More distinct paths than this mean that keys are data, not schema.
MAX_PATHS = 20_000


def _refuse(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


def parse_json(text: str | None) -> tuple[bool, object]:
    """(valid, value) by the JSON grammar; NaN and Infinity are invalid, of repeated keys the last counts."""
    if text is None:
        return False, None
    try:
        return True, json.loads(text, parse_constant=_refuse)
    except (ValueError, RecursionError):
        return False, None


def _opened(value: object) -> object:
    """The value, or what it holds if it is text with a JSON object or list in it."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        ok, inner = parse_json(value)
        if ok and isinstance(inner, (dict, list)):
            return inner
    return value


def _below(path: str, key: str) -> str:
    """Path of a child; an element that contains itself, at any depth, is one element of the schema graph."""
    parts = path.split(".") if path else []
    return ".".join(parts[: parts.index(key) + 1]) if key in parts else ".".join([*parts, key])


def _facts(value: object, path: str, out: set[tuple[str, str, str]], known: dict[tuple[str, str], str]) -> None:
    """Add the keys and lists of a value; ``known`` has the path below each (path, key) met so far."""
    stack = [(value, path)]
    while stack:
        v, p = stack.pop()
        if isinstance(v, str):
            v = _opened(v)
        if isinstance(v, dict):
            for k, x in v.items():
                q = known.get((p, k))
                if q is None:
                    key = k.replace(".", "_")
                    out.add((p, "key", key))
                    q = known[p, k] = _below(p, key)
                    if q != (f"{p}.{key}" if p else key):
                        out.add((q, "list", ""))  # recursive
                if isinstance(x, (dict, list, str)):
                    stack.append((x, q))
        elif isinstance(v, list):
            out.add((p, "list", ""))
            stack.extend((x, p) for x in v if isinstance(x, (dict, list, str)))


@dataclass
class Plan:
    """Which paths have tables, and which paths stand for another one."""

    tables: set[str] = field(default_factory=set)
    alias: dict[str, str] = field(default_factory=dict)
    _children: dict[tuple[str, str], tuple[str, bool]] = field(default_factory=dict)

    def child(self, path: str, key: str) -> tuple[str, bool]:
        """(path of a child by its key, whether it has a table)."""
        got = self._children.get((path, key))
        if got is None:
            p = self.resolve(_below(path, key.replace(".", "_")))
            got = self._children[path, key] = (p, p in self.tables)
        return got

    def resolve(self, path: str) -> str:
        """The path that stands for ``path``, aliases of its ancestors included."""
        seen = 0
        while path not in self.tables and seen < 64:
            parts, hit = path.split("."), None
            for n in range(len(parts), 0, -1):
                head = ".".join(parts[:n])
                if head in self.alias:
                    hit = ".".join([self.alias[head], *parts[n:]])
                    break
            if hit is None:
                return path
            path, seen = hit, seen + 1
        return path


def analyse(df: DataFrame, json_col: str, alike: float = 0.5) -> Plan:
    """Schema graph of a JSON column over all rows. What reaches the driver are the distinct (path, key) facts."""

    def facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: set[tuple[str, str, str]] = set()
        known: dict[tuple[str, str], str] = {}
        for b in batches:
            for text in b[json_col]:
                ok, v = parse_json(text)
                if ok:
                    _facts(v, "", out, known)
        yield pd.DataFrame(sorted(out), columns=["path", "kind", "name"])

    found = df.select(json_col).mapInPandas(facts, "path string, kind string, name string").distinct().limit(MAX_PATHS + 1).collect()
    if len(found) > MAX_PATHS:
        raise ValueError(f"more than {MAX_PATHS} paths: the keys of {json_col} are data")
    keys: dict[str, set[str]] = defaultdict(set)
    lists: set[str] = set()
    for path, kind, name in found:
        if kind == "key":
            keys[path].add(name)
        else:
            lists.add(path)
    plan = Plan()
    for path in sorted(keys, key=lambda p: p.count(".")):
        up = path.rpartition(".")[0]
        if up and keys[path] and len(keys[path] & keys[up]) >= alike * len(keys[path] | keys[up]):
            plan.alias[path] = up
    for path in lists - {""}:
        plan.tables.add(plan.resolve(path))
    return plan


ROWS = pa.schema(
    [("k", pa.string()), ("doc_key", pa.int64()), ("table_name", pa.string()), ("node_id", pa.string()), ("parent_table", pa.string()), ("parent_id", pa.string()), ("ord", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))]
)


def shred(df: DataFrame, key_col: str, json_col: str, plan: Plan | None = None, only: set[str] | None = None) -> DataFrame:
    """All rows of all tables of a JSON column, or of the tables in ``only``, in one frame.

    Columns: ``key_col, doc_key, table_name, node_id, parent_table, parent_id, ord, fields``. ``doc_key`` tells apart
    payloads of one key; repeated (key, payload) rows count once. The record itself has the table ``record``.
    ``fields`` holds the scalars of the row and of its inlined singletons, by path below the row, as text; a scalar item
    of a list is the field ``value``. A null key stays null. Null, empty or invalid JSON and JSON without an object at
    its top (or in a list at its top) yield no row; null items yield no row; null fields are absent. Extra columns of
    ``df`` are dropped.
    """
    plan = plan or analyse(df, json_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for key, doc, text in zip(b.column("k").to_pylist(), b.column("doc_key").to_pylist(), b.column("t").to_pylist(), strict=True):
                ok, top = parse_json(text)
                if ok:
                    for i, rec in enumerate(top if isinstance(top, list) else [top]):
                        if isinstance(rec, dict):
                            _walk(plan, out, key, doc, rec, i)
            if only is not None:
                out = [x for x in out if x[2] in only]
            columns = list(zip(*out, strict=True)) or [[]] * len(ROWS)
            columns[-1] = [list(x.items()) for x in columns[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, ROWS, strict=True)], schema=ROWS)

    kind = df.schema[key_col].dataType
    src = df.select(F.col(key_col).cast("string").alias("k"), F.col(json_col).alias("t")).distinct().withColumn("doc_key", F.xxhash64("t"))  # keys pass as text, exact
    out = src.mapInArrow(rows, f"k string, {NODES}")
    return out.select(F.col("k").cast(kind).alias(key_col), *[c for c in out.columns if c != "k"])


def _walk(plan: Plan, out: list[tuple], key: object, doc: int, rec: dict, i: int) -> None:
    stack: deque[tuple] = deque()
    count: dict[tuple[str | None, str], int] = defaultdict(int)
    child = plan.child

    def node(table: str, parent_table: str | None, parent_id: str | None, value: object) -> None:
        if parent_id is None:
            n, nid = i, str(i)
        else:
            n = count[parent_id, table]
            count[parent_id, table] = n + 1
            nid = f"{parent_id}/{table.rpartition('.')[2]}:{n}"
        fields: dict[str, str] = {}
        out.append((key, doc, table, nid, parent_table, parent_id, n, fields))
        path = "" if table == "record" else table
        if isinstance(value, dict):
            stack.append((value, path, path, table, nid, fields))
        else:
            fields["value"] = value if isinstance(value, str) else json.dumps(value)

    node("record", None, None, rec)
    while stack:
        value, path, base, table, nid, fields = stack.popleft()
        for k, x in value.items():
            if isinstance(x, str):
                x = _opened(x)
            if x is None:
                continue
            p, has_table = child(path, k)
            if has_table:
                if isinstance(x, dict) and any(child(p, c)[0] == p for c in x):
                    stack.appendleft((x, p, base, table, nid, fields))  # a wrapper of the list
                    continue
                items = x if isinstance(x, list) else [x]
                if isinstance(x, str):
                    items = _items(x)
                for item in items:
                    for y in item if isinstance(item, list) else (item,):
                        if (y := _opened(y)) is not None:
                            node(p, table, nid, y)
            elif isinstance(x, dict):
                stack.appendleft((x, p, base, table, nid, fields))
            else:
                name = p[len(base) + 1 :] if base and p.startswith(base + ".") else p
                if name not in fields:
                    fields[name] = x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)


def _items(text: str) -> list[str]:
    """Items of a list given as text: parts between delimiters if each is one token such as an id, else the text as one item."""
    parts = [y for y in DELIMITERS.split(text) if y]
    return parts if all(TOKEN.fullmatch(y) for y in parts) else [text]


def plain_id(col: Column) -> Column:
    """An id without outer white space, in upper case."""
    return F.upper(F.regexp_replace(col, r"(?U)^[\s﻿​]+|[\s﻿​]+$", ""))


_TARGET = "candidates.audit.parsed_output."
TABLES = {"record", "candidates", _TARGET + "evidence", _TARGET + "critical_evidence_ids"}


def candidate_tables(df: DataFrame, key_col: str = "raw_id", json_col: str = "payload") -> dict[str, DataFrame]:
    """Flat tables of a nested candidate payload: ``records, candidates, evidence, critical_ids``.

    Every child names its parents by ``raw_id, doc_key`` and ``candidate_node`` (null candidate_id and evidence ids stay
    null). Evidence and critical ids count only below ``audit.parsed_output`` of a candidate. Ids keep their stored
    form beside ``*_key``, the form in which they are compared.
    """
    src = materialize(df.select(key_col, json_col).where(F.col(json_col).isNotNull()), "shred-in")
    nodes = materialize(shred(spread(src), key_col, json_col, analyse(spread(src), json_col), TABLES), "shred-nodes")
    keys = [key_col, "doc_key"]
    records = nodes.where("table_name = 'record'").select(
        *keys, F.col("node_id").alias("record_node"), *[F.col("fields")[c].alias(c) for c in ("source_id", "split", "base_model")]
    )
    candidates = nodes.where("table_name = 'candidates'").select(
        *keys, F.col("parent_id").alias("record_node"), F.col("node_id").alias("candidate_node"), F.col("ord").alias("candidate_no"),
        F.col("fields")["candidate_id"].alias("candidate_id"), F.col("fields")["origin"].alias("origin"),
        F.col("fields")["audit.parsed_output.final_answer"].alias("final_answer"),
        F.col("fields")["audit.parsed_output.evidence_sufficiency"].alias("evidence_sufficiency"),
    )
    evidence = nodes.where(F.col("table_name") == _TARGET + "evidence").select(
        *keys, F.col("parent_id").alias("candidate_node"), F.col("node_id").alias("evidence_node"), F.col("ord").alias("evidence_no"),
        *[F.col("fields")[a].alias(b) for a, b in (("id", "evidence_id"), ("span", "span"), ("importance", "importance"), ("role", "role"))],
        *[F.col("fields")[c].cast("int").alias(f"span_{c}") for c in ("start", "end")], plain_id(F.col("fields")["id"]).alias("evidence_key"),
    )
    named = F.coalesce(F.col("fields")["value"], F.col("fields")["id"])
    critical = nodes.where(F.col("table_name") == _TARGET + "critical_evidence_ids").select(
        *keys, F.col("parent_id").alias("candidate_node"), F.col("ord").alias("critical_no"), named.alias("critical_id"), plain_id(named).alias("critical_key")
    )
    return {"records": records, "candidates": candidates, "evidence": evidence, "critical_ids": critical}


def named_evidence(df: DataFrame) -> DataFrame:
    """``raw_id, candidate_id, evidence_id``: evidence items that the critical ids of their own candidate name.

    Joined on the candidate's node, not on its id, so null or repeated candidate ids do no harm. Blank ids name nothing.
    """
    t = {k: v.withColumn("owner", F.xxhash64(F.coalesce(F.col("raw_id").cast("string"), F.lit("null")))) for k, v in candidate_tables(df).items()}
    own = ["owner", "doc_key", "candidate_node"]  # a null raw_id is an owner as well; doc_key tells payloads apart
    crit = t["critical_ids"].where("critical_key <> ''").select(*own, F.col("critical_key").alias("evidence_key")).distinct()
    hit = t["evidence"].where("evidence_key <> ''").select(*own, "evidence_key").distinct().join(crit, [*own, "evidence_key"])
    return hit.join(t["candidates"].select(*own, "raw_id", "candidate_id"), own).select("raw_id", "candidate_id", F.col("evidence_key").alias("evidence_id")).distinct()
