"""Evaluation items inside a training corpus, by template canonicalisation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestream.llm.textkeys import bit_table, bits_of, canonical, distinct_windows, in_table, runs, split_windows
from lodestream.session import materialize, spread

#: Characters of a piece by which containment is measured, and symbols of a template window.
PIECE, WINDOW = 8, 6
#: Most items whose windows are broadcast; more are joined by shuffle, with the same result.
BROADCAST_ITEMS = 20_000

# Units of measurement in canonical form, longest first.
_UNITS = "mmoll μmoll umoll moll mgdl ngml pgml iuml mlmin mmhg mgl ngl ugl μgl gl ul iul kpa mg ml mm cm kg iu bpm"
# Frequent Chinese family names, and what follows one where a person is named.
_FAMILY = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许韩冯邓曹彭曾肖田董袁潘于蒋蔡余杜叶程苏魏吕丁任沈姚卢姜崔钟谭陆汪范金石廖贾夏韦付方白邹孟熊秦邱江尹薛闫段雷侯龙史陶黎贺顾毛郝龚邵万钱严武戴莫孔向汤"
_CALLED = "某某|某|先生|女士|小姐|大爷|大妈|大叔|阿姨|奶奶|爷爷|师傅|老师|同学|医生|大夫|主任"
_PART = re.compile(f"[0-9a-z]+|[{_FAMILY}](?:{_CALLED})")
_SLOT = re.compile(
    r"(?P<number>\d+)(?P<unit>(?:" + "|".join(sorted(_UNITS.split(), key=len, reverse=True)) + r")(?![a-z]))?"
    r"|(?P<name>(?<![a-z])[a-z]{2,10}(?![a-z]))"
)


def template(canon: str) -> tuple[str, list[str]]:
    """(template of a canonical text, values of its slots in order): # for a number, ~ for its unit, @ for a Latin word in
    Chinese text or a Chinese family name with a title."""
    slots: list[str] = []

    def put(m: re.Match) -> str:
        if m["number"]:
            slots.append(m["number"] + (m["unit"] or ""))
            return "#~" if m["unit"] else "#"
        slots.append(m["name"])
        return "@"

    def part(m: re.Match) -> str:
        if m[0].isascii():
            return _SLOT.sub(put, m[0])
        slots.append(m[0])
        return "@"

    return _PART.sub(part, canon), slots


class ItemIndex:
    """Template windows and pieces of evaluation items."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.ids = [i for i, _ in items]
        texts = [canonical(q) for _, q in items]
        tmpl = [template(c) for c in texts]
        self.templates, self.slots = [t for t, _ in tmpl], [v for _, v in tmpl]
        self.pieces, self.piece_item, self.size = self._flat(texts, PIECE)
        self.windows, self.window_item, self.template_size = self._flat(self.templates, WINDOW)
        self.piece_bits, self.window_bits = bits_of(self.pieces), bits_of(self.windows)

    @staticmethod
    def _flat(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, item = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
        for part in runs(texts):
            i, x = split_windows(distinct_windows(texts[part], width))
            h.append(x), item.append(i + part.start)
        h, item = np.concatenate(h), np.concatenate(item)
        order = np.argsort(h, kind="stable")
        return h[order], item[order], np.bincount(item, minlength=len(texts))

    @staticmethod
    def common(sorted_hashes: np.ndarray, item: np.ndarray, text: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(text * n + item, number of distinct hashes both have) of the texts and items with a common hash."""
        lo = np.searchsorted(sorted_hashes, h, "left")
        on = np.flatnonzero(sorted_hashes[np.minimum(lo, len(sorted_hashes) - 1)] == h) if len(sorted_hashes) else np.empty(0, dtype=np.int64)
        lo = lo[on]
        size = np.searchsorted(sorted_hashes, h[on], "right") - lo
        at = np.repeat(lo - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.unique(np.repeat(text[on], size) * n + item[at], return_counts=True)

    def match(self, texts: list[str], share: float, template_share: float) -> list[tuple[int, int, float, float, float, bool]]:
        """(text, item, share of its pieces, share of its template windows, share of its slots with the same value, whether
        its slots are replaced consistently)."""
        n, out = len(self.ids), []
        canon = [canonical(t) for t in texts]
        for part in runs(canon):
            tmpl = [template(c) for c in canon[part]]
            p, pn = self.common(self.pieces, self.piece_item, *split_windows(distinct_windows(canon[part], PIECE, self.piece_bits)), n)
            w, wn = self.common(self.windows, self.window_item, *split_windows(distinct_windows([t for t, _ in tmpl], WINDOW, self.window_bits)), n)
            both = np.union1d(p, w)
            whole, form = np.zeros(len(both), dtype=np.int64), np.zeros(len(both), dtype=np.int64)
            whole[np.searchsorted(both, p)], form[np.searchsorted(both, w)] = pn, wn
            i = both % n if n else both
            size, frame = self.size[i], self.template_size[i]
            kept = ((size > 0) & (whole >= share * size - 1e-9)) | ((frame > 0) & (form >= template_share * frame))
            for k in np.flatnonzero(kept):
                t, item = divmod(int(both[k]), n)
                same, fits = self.replaced(item, *tmpl[t])
                out.append((part.start + t, item, whole[k] / max(1, size[k]), form[k] / max(1, frame[k]), same, fits))
        return out

    def replaced(self, item: int, tmpl: str, slots: list[str]) -> tuple[float, bool]:
        """(share of the item's slots that have the same value in a text, whether each value always became the same one).

        The text's template is laid over the item's where most of their windows agree; slots that meet no slot count as different and as unchanged.
        """
        own, values = self.templates[item], self.slots[item]
        if not values:
            return 1.0, True
        shifts: Counter[int] = Counter()
        for i in range(len(own) - WINDOW + 1):
            at = tmpl.find(own[i : i + WINDOW])
            while at >= 0:
                shifts[at - i] += 1
                at = tmpl.find(own[i : i + WINDOW], at + 1)
        if not shifts:
            return len(set(values) & set(slots)) / len(set(values)), True
        shift = min(shifts, key=lambda k: (-shifts[k], k))
        here = dict(zip([i for i, c in enumerate(tmpl) if c in "#@"], slots, strict=True))
        became = [(v, here.get(i + shift)) for i, v in zip([i for i, c in enumerate(own) if c in "#@"], values, strict=True)]
        to: dict[str, set[str]] = {}
        for v, x in became:
            if x is not None:
                to.setdefault(v, set()).add(x)
        return sum(v == x for v, x in became) / len(values), all(len(x) == 1 for x in to.values())


KINDS = "whole double, template double, slots double, fits boolean"


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, question: str, share: float = 0.5, template_share: float = 0.85
) -> DataFrame:
    """``doc_id, item_id, whole, template, slots, kind`` of documents that give away items; each pair once.

    A document and an item that share a template window or an exact piece are candidates. ``whole`` is the share of the item's distinct
    8-character pieces (canonical form) that the document has, ``template`` the share of its template windows,
    ``slots`` the share of its numbers and names that stand in their place. kind is ``exact`` (all pieces), ``partial`` (at least ``share`` of
    them), or ``reparameterised`` (fewer, but at least ``template_share`` of the template, of its slots not all, and each
    value replaced by one other value wherever it stands). Null or empty questions and texts match nothing; of several texts of an id all count, with the best shares.
    Items shorter than 8 characters have no pieces. Extra columns are dropped.
    """
    q = items.select(F.col(item_id).cast("string").alias("i"), F.col(question).alias("q")).where("i is not null and q is not null and q <> ''").distinct()
    kind = docs.schema[doc_id].dataType
    d = docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t")).where("t is not null and t <> ''")  # ids pass as text, exact
    few = q.limit(BROADCAST_ITEMS + 1).collect()
    cols = ["d", "i", "whole", "template", "slots", "fits"]
    if len(few) <= BROADCAST_ITEMS:
        held = docs.sparkSession.sparkContext.broadcast(ItemIndex(sorted((r["i"], r["q"]) for r in few)))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                did = b["d"].tolist()
                yield pd.DataFrame([(did[t], held.value.ids[i], *x) for t, i, *x in held.value.match(b["t"].tolist(), share, template_share)], columns=cols)

        out = spread(d).mapInPandas(run, f"d string, i string, {KINDS}")
    else:
        out = _by_shuffle(d, q, share, template_share)
    out = out.groupBy("d", "i").agg(F.max("whole").alias("whole"), F.max("template").alias("template"), F.max("slots").alias("slots"), F.bool_or("fits").alias("fits"))
    form = F.when(F.col("whole") >= 1, "exact").when(F.col("whole") >= share, "partial").when((F.col("slots") < 1) & (F.col("template") >= template_share) & F.col("fits"), "reparameterised")
    return out.select(F.col("d").cast(kind).alias(doc_id), F.col("i").alias(item_id), *cols[2:5], form.alias("kind")).where("kind is not null")


def _by_shuffle(d: DataFrame, q: DataFrame, share: float, template_share: float) -> DataFrame:
    """The same for any number of items: hashes of windows and pieces joined by shuffle, candidates compared text by text.

    Of an item's n pieces a document that has the share s of them has one of any n - ceil(s n) + 1, and so with windows; only the
    so many that fewest documents have are joined. Documents give only hashes that some item has.
    """

    def hashes(want: object):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                canon, key = [canonical(t) for t in b.column("x").to_pylist()], b.column("k").to_numpy()
                for part in runs(canon):
                    for kind, texts, width in ((0, canon[part], PIECE), (1, [template(c)[0] for c in canon[part]], WINDOW)):
                        text, h = split_windows(distinct_windows(texts, width))
                        h = 2 * h.view(np.int64) + kind
                        on = slice(None) if want is None else in_table(want.value, h.view(np.uint64))
                        yield pa.RecordBatch.from_arrays([pa.array(key[part][text[on]]), pa.array(h[on])], ["k", "h"])

        return run

    dk = materialize(d.withColumn("k", F.xxhash64("t")), "leak-docs")
    qk = materialize(q.withColumn("k", F.xxhash64("q")), "leak-items")
    wq = materialize(qk.select("k", F.col("q").alias("x")).dropDuplicates(["k"]).mapInArrow(hashes(None), "k bigint, h bigint").toDF("qk", "h"), "leak-windows")
    want = d.sparkSession.sparkContext.broadcast(bit_table(wq, "h", wq.count()))
    wd = materialize(dk.select("k", F.col("t").alias("x")).dropDuplicates(["k"]).mapInArrow(hashes(want), "k bigint, h bigint"), "leak-hits")
    has = wd.groupBy("h").agg(F.count(F.lit(1)).alias("docs"))
    own = Window.partitionBy("qk", F.pmod("h", F.lit(2)))
    rare = wq.join(has, "h", "left").select("qk", "h", F.coalesce("docs", F.lit(0)).alias("docs"))
    need = F.col("n") - F.ceil(F.col("n") * F.when(F.pmod("h", F.lit(2)) == 0, F.lit(share)).otherwise(F.lit(template_share)) - 1e-9) + 1
    rare = rare.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("rank", F.row_number().over(own.orderBy("docs", "h"))).where((F.col("rank") <= need) & (F.col("docs") > 0))
    pair = wd.join(rare.select("qk", "h"), "h").select("k", "qk").distinct()
    x = pair.join(dk, "k").join(qk.withColumnRenamed("k", "qk"), "qk").select("d", "t", "i", "q")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for did, t, i, question in zip(b["d"], b["t"], b["i"], b["q"], strict=True):
                rows += [(did, i, *found) for _, _, *found in ItemIndex([(i, question)]).match([t], share, template_share)]
            yield pd.DataFrame(rows, columns=["d", "i", "whole", "template", "slots", "fits"])

    return x.mapInPandas(run, f"d string, i string, {KINDS}")
