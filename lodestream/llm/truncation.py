"""Text values cut off inside a word or a sentence.

A self-join by prefix on two levels, both on hashes, in one pass over all values:
* values: the hash of every prefix of every value is looked up among the values that lack a closing mark, which finds values
  that are strict prefixes of longer copies elsewhere; a copy that goes on inside a sentence decides;
* tails: the last 16, 11, 8, 6, 4, 3 and 2 characters of a value that lacks a closing mark are looked up inside all other
  values. A tail that goes on there nearly always was cut; one that ends a sentence or a text there is complete.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.textkeys import BASE, bit_table, codes, in_table, mix, windows
from lodestream.session import materialize, spread

#: Lengths of the tails, longest first.
TAILS = (16, 11, 8, 6, 4, 3, 2)
#: A shorter value may be how any sentence begins, so it is judged by its tails alone, not by longer copies.
PREFIX = 16
#: Characters hashed at once.
PART = 2_000_000
#: Least number of other values with a tail for it to count, and least share that goes on.
SUPPORT, GOES_ON = 3, 0.5

_BLANK = " \t\r\n　 ​‌‍﻿"
_END = "。！？!?．｡"
_CLOSE = "”’」』）)】]》\"'"
#: Words that stand for no answer, without marks and blanks, in lower case.
FILLERS = frozenset("无 暂无 略 空 待补充 待填 未填 未提供 没有 na n/a none null nil tbd todo nan undefined empty 无内容 省略".split())
_LONGEST = max(map(len, FILLERS))
_NUMBER = re.compile(r"[0-9０-９]+(?:[.．][0-9０-９]+)*")
_DOTS = re.compile(r"(?:…|\.{3,})+$")


def plain(text: str) -> str:
    """Outer blanks dropped and every number one 0."""
    return _NUMBER.sub("0", text.strip(_BLANK))


def is_empty(text: str | None) -> bool:
    """Null, or no letter or digit, or nothing but a filler."""
    word, letters = [], 0
    for c in text or "":
        if c.isalnum():
            letters += 1
            if letters > _LONGEST:
                return False
        if c.isalnum() or c == "/":
            word.append(c)
    plain_word = "".join(word).lower().strip("/")
    return not plain_word or plain_word in FILLERS


def tail_state(text: str) -> tuple[str, str]:
    """(state, stem): ``closed`` by a mark, ``broken`` inside a character, ``empty``, or ``open``; the stem is the text to judge."""
    s = text.rstrip(_BLANK)
    if s.endswith("�"):
        return "broken", s
    t = s
    run = len(t.rstrip("…."))
    dots = _DOTS.search(t, run) if run < len(t) else None
    if dots:
        t = t[: dots.start()].rstrip(_BLANK)
    if is_empty(t):
        return "empty", ""
    u = t.rstrip(_CLOSE)
    if u and u[-1] in _END:
        return "closed", t
    if u and u[-1] == ".":
        if not (len(u) > 1 and u[-2].isdigit()):
            return "closed", t
        t = u[:-1]
    return "open", t


def _seed(group: str, k: int) -> np.uint64:
    return windows(codes(f"{group}/{k}".rjust(8)), 8)[0]


STOPS = np.array(sorted({ord(c) for c in _END + "…\n"}), dtype=np.uint64)
AFTER_DOT = np.array([ord(c) for c in " \n)\"'."], dtype=np.uint64)
_NEWLINE = np.uint64(10)


class Joined:
    """Texts in one array of code points, two line breaks after each."""

    def __init__(self, texts: list[str]) -> None:
        self.code = codes("\n\n".join([*texts, ""]))
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.length + 2) - self.length - 2
        self.offset = np.arange(len(self.code)) - np.repeat(self.start, self.length + 2)

    def prefixes(self, group: str, at: np.ndarray) -> np.ndarray:
        """Hashes that name what each text has up to the positions ``at``, its length included."""
        with np.errstate(over="ignore"):
            most = int(self.length.max(initial=0)) + 2
            power = np.cumprod(np.r_[np.uint64(1), np.full(most, BASE)])
            total = np.r_[np.uint64(0), np.cumsum((self.code + np.uint64(1)) * power[self.offset])]
            h = total[at + 1] - total[at - self.offset[at]]
            return mix(mix(h) + (self.offset[at] + 1).astype(np.uint64) * BASE + _seed(group, 0))

    def tails(self, group: str, at: np.ndarray, want: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, positions, hashes) of the last k characters up to the positions ``at``, shortest first.

        With ``want`` only those in that table; a longer tail is looked up only where the shorter one is in it, as a
        value that has the longer has the shorter as well.
        """
        one = np.uint64(1)
        h, power = np.zeros(len(at), dtype=np.uint64), one
        with np.errstate(over="ignore"):
            for j in range(TAILS[0]):
                keep = self.offset[at] >= j
                if not keep.all():
                    at, h = at[keep], h[keep]
                h = h + (self.code[at - j] + one) * power
                power = power * BASE
                if j + 1 in TAILS:
                    x = mix(mix(h) + _seed(group, j + 1))
                    if want is not None:
                        hit = in_table(want, x)
                        at, h, x = at[hit], h[hit], x[hit]
                    if len(at):
                        yield j + 1, at, x

    def goes_on(self, at: np.ndarray, dot: bool) -> np.ndarray:
        """Whether a sentence goes on after the positions ``at``; with ``dot`` a full point inside a word does so too."""
        nxt = self.code[at + 1]
        point = nxt == 46
        if dot:
            point &= np.isin(self.code[np.minimum(at + 2, len(self.code) - 1)], AFTER_DOT)
        return ~(np.isin(nxt, STOPS) | point)


def parts(texts: list[str], most: int = PART) -> Iterator[slice]:
    """Runs of texts of some million characters, single texts at least."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most or i + 1 == len(texts):
            yield slice(start, i + 1)
            start, size = i + 1, 0


def _continuations(group: str, texts: list[str], want: np.ndarray, wholes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, length or 0, goes on) of every looked-for piece in the texts: tails (0), and values that a text goes on after (length)."""
    for part in parts(texts):
        x = Joined(texts[part])
        inner = np.flatnonzero(x.offset < np.repeat(x.length, x.length + 2) - 1)  # the last character of a text is followed by nothing
        for _, at, h in x.tails(group, inner, want):
            yield h, np.zeros(len(h), dtype=np.int32), x.goes_on(at, True)
        at = inner[x.offset[inner] >= PREFIX - 1]
        h = x.prefixes(group, at)
        hit = in_table(wholes, h)
        at, h = at[hit], h[hit]
        go = x.goes_on(at, False)
        yield h[go], (x.offset[at[go]] + 1).astype(np.int32), np.ones(int(go.sum()), dtype=bool)


def truncated_values(df: DataFrame, group: str, key: str, text: str, probe: str | None = None) -> DataFrame:
    """``group, key`` (as strings) of the values that break off inside a word or a sentence; each once.

    Values are judged against the other values of their group. Null keys and groups are allowed; null and empty values,
    and values without a letter or digit, are not truncated. A value that lacks a closing mark is complete unless its
    tail goes on elsewhere or a longer copy of it goes on inside a sentence; too little evidence counts as complete. Rows
    whose boolean column ``probe`` is true are judged, but are no evidence for others. Extra columns are dropped.
    """
    src = df.select(
        F.coalesce(F.col(group).cast("string"), F.lit("")).alias("g"), F.col(group).cast("string").alias("group"), F.col(key).cast("string").alias("key"), F.col(text).alias("text"),
        (F.coalesce(F.col(probe), F.lit(False)) if probe else F.lit(False)).alias("probe"),
    )
    src = spread(src.where("text is not null"))
    sc = df.sparkSession.sparkContext

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            state, stem = zip(*map(tail_state, b["text"]), strict=True) if len(b) else ((), ())
            b = b.assign(state=state, stem=[plain(x) for x in stem]).drop(columns="text")
            b = b[b["state"].isin(["open", "broken"])]
            for g, own in b.groupby("g"):
                for part in parts(own["stem"].tolist()):
                    out = own.iloc[part]
                    x = Joined(out["stem"].tolist())
                    end = x.start + x.length - 1
                    some = np.flatnonzero(x.length > 0)
                    whole, hs = np.zeros(len(out), dtype=np.uint64), [[] for _ in range(len(out))]
                    whole[some] = x.prefixes(g, end[some])
                    row = np.full(len(x.code), -1)
                    row[end[some]] = some
                    for _, at, h in x.tails(g, end[some]):
                        for i, v in zip(row[at].tolist(), h.view(np.int64).tolist(), strict=True):
                            hs[i].append(v)
                    yield out[["group", "g", "key", "state", "probe"]].assign(hs=hs, whole=whole.view(np.int64), len=x.length.astype(np.int32))

    tail = materialize(src.mapInPandas(tails, "`group` string, g string, key string, state string, probe boolean, hs array<bigint>, whole bigint, len int"), "tails")
    # values that are equal are judged once; ks are the lengths of TAILS in rising order, as many as the value has
    distinct = tail.where("state = 'open'").groupBy("g", "whole", "len").agg(F.first("hs").alias("hs"), F.bool_and("probe").alias("probe"))
    distinct = materialize(distinct, "tail-values")
    each = distinct.select("g", "whole", "len", "probe", F.posexplode("hs").alias("k", "h"))
    n = distinct.count()
    want = sc.broadcast(bit_table(each, "h", n * len(TAILS)))
    wholes = sc.broadcast(bit_table(distinct.where(F.col("len") >= PREFIX), "whole", n))

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How often looked-for tails go on (c) among all (n), and values that a longer copy goes on after."""
        for b in batches:
            texts, group = [plain(t) for t in b.column("text").to_pylist()], np.array(b.column("g").to_pylist(), dtype=object)
            for g in set(group):
                found = list(_continuations(g, [texts[i] for i in np.flatnonzero(group == g)], want.value, wholes.value))
                h, size, o = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, bool))
                for n in (0, 1):
                    on = (size > 0) == n
                    u, first, at = np.unique(h[on], return_index=True, return_inverse=True)
                    c = np.bincount(at, weights=o[on], minlength=len(u)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(size[on][first], pa.int32()), pa.array(np.bincount(at, minlength=len(u)).astype(np.int64)), pa.array(c)], ["h", "len", "n", "c"])

    inside = src.where("not probe").select("g", "text").mapInArrow(follow, "h bigint, len int, n bigint, c bigint").groupBy("h", "len").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    inside = materialize(inside, "tail-inside")
    ends = each.where("not probe").groupBy("h").agg(F.count(F.lit(1)).alias("e"))
    other = F.coalesce("e", F.lit(0)) - F.when(F.col("probe"), 0).otherwise(1)
    seen = each.join(ends, "h", "left").join(inside.where("len = 0").drop("len"), "h", "left").select("g", "whole", "len", "k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("c", F.lit(0)).alias("c"), other.alias("e"))
    share = F.max_by(F.col("c") / (F.col("n") + F.col("e")), "k")
    cut = seen.where(F.col("n") + F.col("e") >= SUPPORT).groupBy("g", "whole", "len").agg(share.alias("share")).where(F.col("share") >= GOES_ON).select("g", "whole", "len")
    copied = distinct.join(inside.where("len > 0").select(F.col("h").alias("whole"), "len"), ["whole", "len"]).select("g", "whole", "len")
    cut = cut.unionByName(copied).distinct()
    out = tail.where("state = 'open'").join(cut, ["g", "whole", "len"]).select("group", "key").unionByName(tail.where("state = 'broken'").select("group", "key"))
    return out.select(F.col("group").alias(group), F.col("key").alias(key)).distinct()


def text_fields(documents: DataFrame, audited: DataFrame) -> DataFrame:
    """``field, record_key, source, text`` of documents.text (source normalised) and audited.target.final_answer (its teacher_model)."""
    src = F.lower(F.regexp_replace("source", r"(?U)^\s+|\s+$", ""))
    a = documents.select(F.lit("documents.text").alias("field"), F.col("doc_id").cast("string").alias("record_key"), src.alias("source"), "text")
    b = audited.select(F.lit("final_answer").alias("field"), F.col("source_id").alias("record_key"), F.col("teacher_model").alias("source"), F.col("target.final_answer").alias("text"))
    return a.unionByName(b)


def truncation_rates(fields: DataFrame) -> DataFrame:
    """``field, source, values, truncated, rate`` over non-null values; repeated records count once."""
    f = fields.where("text is not null").select("field", "record_key", "source").distinct()
    hit = truncated_values(fields, "field", "record_key", "text").withColumn("hit", F.lit(1))
    x = f.join(hit, ["field", "record_key"], "left").groupBy("field", "source")
    return x.agg(F.count(F.lit(1)).alias("values"), F.coalesce(F.sum("hit"), F.lit(0)).alias("truncated")).withColumn("rate", F.round(F.col("truncated") / F.col("values"), 6))
