"""One consistent spelling for visually identical text.

Two kinds of look-alikes are told apart. Characters that are the same letter in another dress (full width, another script,
accents composed or not, invisible ones) are replaced by table. Letters and digits that look alike but are each a character of
its own (l, I and 1; O and 0) no table may replace: there the vocabulary decides. All spellings of the corpus that look the
same form one class, its most frequent one is canonical, and the tokens of a text are read through a trie of these spellings by an automaton
to which look-alikes and ignorables cost nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestream.session import materialize, spread

# Characters that look like another one, beyond the compatibility forms of Unicode, and that one.
LOOKALIKES = dict(
    zip(
        "кԌԚԜѵѴρναικυγɡɑıɩАВЕЅІЈКМНОРСТУХҮӀаеѕіјорсухһԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳօ‐‑‒–−’‘ʼ⻄⻅⻆⻉⻋⻓⻑⻔⻘⻙⻚⻛⻜⻝⻢⻤⻥⻦⻨⻩⻬⻮⻰⺠",
        "kGQWvVpvaikuygaiiABESIJKMHOPCTYXYIaesijopcyxhdqwABEZHIKMNOPTYXocjo-----'''西见角贝车长長门青韦页风飞食马鬼鱼鸟麦黄齐齿龙民",
        strict=True,
    )
)
_IGNORED = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁤⁦-⁯ㅤ︀-️﻿ﾠ]")
_TABLE = str.maketrans(LOOKALIKES)
# Characters that look the same though each is one of its own.
TWINS = ("1lI|", "0O")
_TWIN = {c: group for group in TWINS for c in group}
_FIRST = str.maketrans({c: group[0] for c, group in _TWIN.items()})
_ANY_TWIN = re.compile("[1lI|0O]")
_INVISIBLE = _IGNORED.pattern[1:-1]
#: A run of letters and digits of alphabetic scripts, with what is invisible in it.
_TOKEN = re.compile(f"(?:[^\\W_⺀-鿿豈-﫿]|[|̀-ͯ{_INVISIBLE}])+")
#: Most spellings in the trie, the most frequent first; tokens beyond are normalised by table.
VOCABULARY = 200_000


def ignorable(c: str) -> bool:
    """Whether a character takes no room on the page."""
    return bool(_IGNORED.match(c))


def fold(text: str) -> str:
    """Ignorables dropped, compatibility forms and accents composed, look-alikes replaced by table. Case stays."""
    t = _IGNORED.sub("", text)
    return t if t.isascii() else unicodedata.normalize("NFKC", t).translate(_TABLE)


def skeleton(word: str) -> str:
    """What all spellings have in common that look the same."""
    return fold(word).translate(_FIRST)


class SpellingTrie:
    """Vocabulary trie with a weighted edit automaton.

    Reading an ignorable costs nothing and stays; reading a character costs nothing along any spelling of it that looks
    the same, by table (also several characters for one) or as a twin; a letter more, less or another costs ``other``.
    """

    def __init__(self, words: list[str], other: float = 1.0) -> None:
        self.root: dict = {}
        self.other = other
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    @staticmethod
    def clusters(token: str) -> list[str]:
        """Base characters with the combining marks that follow, ignorables left out."""
        out: list[str] = []
        for c in token:
            if ignorable(c):
                continue
            if out and unicodedata.combining(c):
                out[-1] += c
            else:
                out.append(c)
        return out

    @staticmethod
    def along(node: dict, looks: str) -> list[dict]:
        """The nodes that spellings of ``looks`` lead to."""
        nodes = [node]
        for x in looks:
            nodes = [n[y] for n in nodes for y in _TWIN.get(x, x) if y in n]
        return nodes

    def find(self, token: str, budget: float = 0.0) -> str | None:
        """The spelling reached at the lowest cost within ``budget``; the first in code-point order among equals."""
        step: dict[int, tuple[float, dict]] = {}

        def reach(cost: float, node: dict) -> None:
            """Enter a node and, at the cost of a letter that the token lacks, what lies below it."""
            if cost <= budget and (id(node) not in step or step[id(node)][0] > cost):
                step[id(node)] = (cost, node)
                if cost + self.other <= budget:
                    for x, child in node.items():
                        if x:
                            reach(cost + self.other, child)

        reach(0.0, self.root)
        states = list(step.values())
        for c in self.clusters(token):
            step = {}
            looks = fold(c)
            for cost, node in states:
                for child in self.along(node, looks):
                    reach(cost, child)
                if cost + self.other <= budget:
                    reach(cost + self.other, node)
                    for x, child in node.items():
                        if x:
                            reach(cost + self.other, child)
            states = list(step.values())
            if not states:
                return None
        done = [(cost, node[""]) for cost, node in states if "" in node]
        return min(done)[1] if done else None


def spellings(texts: DataFrame, text: str, size: int = VOCABULARY) -> list[str]:
    """The canonical spellings of what is spelled in several ways that look the same, over whole texts of all rows.

    Of each class the most frequent spelling, the first in code-point order among equals; of the classes the ``size`` most frequent ones. Spellings of
    twins alone (as 1 or II) belong to no class, as nothing tells which of them is meant. What is spelled in one way needs no entry.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter[str] = Counter()
            for t in b.column(text).to_pylist():
                if t:
                    seen.update(w for w in _TOKEN.findall(t) if len(w) > 1)
            tidy: Counter[str] = Counter()
            for w, n in seen.items():
                w = fold(w)
                if len(w) > 1 and _ANY_TWIN.search(w) and _ANY_TWIN.sub("", w):
                    tidy[w] += n
            yield pa.RecordBatch.from_arrays([pa.array([w.translate(_FIRST) for w in tidy], pa.string()), pa.array(list(tidy), pa.string()), pa.array(list(tidy.values()), pa.int64())], ["s", "w", "n"])

    words = texts.select(text).mapInArrow(count, "s string, w string, n bigint").groupBy("s", "w").agg(F.sum("n").alias("n"))
    best = F.min_by("w", F.struct((-F.col("n")).alias("n"), "w")).alias("w")
    classes = words.groupBy("s").agg(best, F.count(F.lit(1)).alias("ways"), F.sum("n").alias("n")).where("ways > 1")
    return sorted(r["w"] for r in classes.orderBy(F.desc("n"), "s").limit(size).collect())


def consistent(text: str, trie: SpellingTrie) -> str:
    """The text in its one form: tokens with a known spelling by the trie, everything else by table."""
    if not trie.root:
        return fold(text)
    t = text if text.isascii() else unicodedata.normalize("NFC", text)
    out = _TOKEN.sub(lambda m: trie.find(m[0]) or m[0] if _ANY_TWIN.search(fold(m[0])) else m[0], t)
    return fold(out)


def with_consistent_text(df: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """``df`` with ``<column>_same`` beside each text column. Null stays null; nothing else changes."""
    trie = df.sparkSession.sparkContext.broadcast(SpellingTrie(words))
    schema = StructType([*df.schema.fields, *(StructField(f"{c}_same", StringType()) for c in columns)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(**{f"{c}_same": [None if t is None else consistent(t, trie.value) for t in b[c]] for c in columns})

    return df.mapInPandas(run, schema)


def items_and_cases(audited: DataFrame, candidate: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``source_id, evidence_id, span`` of the distinct evidence items with a span, ``source_id, case_text`` of the distinct cases)."""
    e = audited.select("source_id", F.explode("target.evidence").alias("e")).select("source_id", F.col("e.id").alias("evidence_id"), F.col("e.span").alias("span"))
    return e.where("span is not null and span <> ''").distinct(), candidate.select("source_id", "case_text").where("case_text is not null").distinct()


def _vocabulary(audited: DataFrame, candidate: DataFrame) -> list[str]:
    spans = audited.select(F.explode("target.evidence.span").alias("text"))
    return spellings(spread(candidate.select(F.col("case_text").alias("text"))).unionByName(spans), "text")


def consistent_spans(audited: DataFrame, candidate: DataFrame) -> DataFrame:
    """Spans and cases in one form: ``source_id, evidence_id, span, case_text, span_same, case_text_same, found, found_same``.

    One row for each distinct item and case of its source_id; null spans, evidence and cases give none. Every case is normalised once.
    """
    words = _vocabulary(audited, candidate)
    items, cases = items_and_cases(audited, candidate)
    items = with_consistent_text(items, ["span"], words)
    cases = with_consistent_text(spread(materialize(cases, "cases")), ["case_text"], words)
    x = items.join(cases, "source_id").select("source_id", "evidence_id", "span", "case_text", "span_same", "case_text_same")
    return x.withColumn("found", F.contains("case_text", "span")).withColumn("found_same", (F.col("span_same") != "") & F.contains("case_text_same", "span_same"))


def hidden_spans(audited: DataFrame, candidate: DataFrame) -> DataFrame:
    """``source_id, evidence_id`` of items whose span occurs in the case only once look-alikes are made the same.

    Only what is not found as it stands needs the one form, so only that is normalised.
    """
    items, cases = items_and_cases(audited, candidate)
    unfound = materialize(items.join(cases, "source_id").where(~F.contains("case_text", "span")), "unfound-spans")
    x = with_consistent_text(spread(unfound), ["span", "case_text"], _vocabulary(audited, candidate))
    return x.where((F.col("span_same") != "") & F.contains("case_text_same", "span_same")).select("source_id", "evidence_id").distinct()
