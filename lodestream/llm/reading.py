"""Reading level of each document by harmonic propagation on the document-word graph."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.textkeys import BASE, codes, mix
from lodestream.session import materialize, spread

#: Word nodes are the least power of two of NODES for each distinct word between these bounds; beyond, words share nodes.
#: The values of the nodes (not the documents') pass through the driver.
NODES, FEWEST, MOST = 4, 1 << 16, 1 << 23
#: Nodes whose sums travel in one row.
BLOCK = 1024
#: One in so many distinct words (by hash) is counted to size the graph.
COUNTED = 256
#: Widths of the character windows that serve as words, in Chinese and in Latin script.
HAN, LATIN = (2,), (5,)
LEVELS = (1, 2, 3, 4, 5)
#: Pull of a word's value to the mean, weight of an ungraded document, and floor of a word's variance.
PULL, FREE, FLOOR = 0.5, 0.3, 0.15
#: Rounds in which the weights of words are learnt, largest change of a word's value at which the iteration has converged,
#: and rounds after which it ends in any case.
LEARN, TOLERANCE, ROUNDS = 2, 0.01, 40
#: Weight, in documents, of the straight line through all grades in the place of a level on the score scale.
LINE = 2.0

_DIGITS = re.compile(r"[0-9]+(?:\.[0-9]+)*")


def words(texts: list[str | None], most: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """(number of distinct words of each text, 32-bit hashes of them, text by text); numbers are one word, whatever their digits."""
    clean = [_DIGITS.sub("0", unicodedata.normalize("NFKC", t).lower()) if t else "" for t in texts]
    count, out = np.zeros(len(clean), dtype=np.int64), []
    start = size = 0
    for i, t in enumerate(clean):
        size += len(t)
        if size < most and i + 1 < len(clean):
            continue
        code = codes("\n".join([*clean[start : i + 1], ""]))
        length = np.array([len(x) + 1 for x in clean[start : i + 1]], dtype=np.int64)
        text = np.repeat(np.arange(len(length), dtype=np.uint64) << np.uint64(32), length)
        found = []
        for widths, mask in ((HAN, (code >= 0x4E00) & (code <= 0x9FFF)), (LATIN, ((code >= 97) & (code <= 122)) | (code == 32))):
            runs = np.cumsum(np.r_[0, mask])
            for k in widths:
                at = np.flatnonzero(runs[k:] - runs[:-k] == k) if len(code) >= k else np.empty(0, dtype=np.int64)  # the line break between texts is in no script
                h = np.zeros(len(at), dtype=np.uint64)
                with np.errstate(over="ignore"):
                    for j in range(k):
                        h = h * BASE + code[at + j] + np.uint64(1)
                    found.append(text[at] | (mix(h) >> np.uint64(32)))
        both = np.unique(np.concatenate(found))
        count[start : i + 1] = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(length))
        out.append((both & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        start, size = i + 1, 0
    return count, np.concatenate(out) if out else np.empty(0, dtype=np.uint32)


def means(text: np.ndarray, value: np.ndarray, weight: np.ndarray, count: int) -> np.ndarray:
    """Weighted mean of its words' values for each text, NaN without a known word."""
    total = np.bincount(text, weights=weight, minlength=count)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(text, weights=weight * value, minlength=count) / np.where(total > 0, total, np.nan)


class Nodes:
    """Word nodes: sums over their documents of weight, value and squared value, the word's value and its weight in a document."""

    def __init__(self, n: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        self.n, self.s, self.q = n, s, q
        self.mean = s.sum() / n.sum() if n.sum() else 0.0
        self.value = self._value(n, s)
        self.weight = self._weight(n, self.value, q)

    def _value(self, n: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (s + PULL * self.mean) / (n + PULL)

    @staticmethod
    def _weight(n: np.ndarray, value: np.ndarray, q: np.ndarray) -> np.ndarray:
        spreading = np.maximum(q / np.maximum(n, 1e-12) - value**2, 0)
        return np.where(n > 1e-9, n / (n + 3) / (spreading + FLOOR), 0)

    def moved(self, s: np.ndarray) -> float:
        """Take new sums of values, the weights stay; the largest change of a word's value."""
        old, self.s = self.value, s
        self.mean = s.sum() / self.n.sum() if self.n.sum() else 0.0
        self.value = self._value(self.n, s)
        return float(np.abs(self.value - old)[self.n > 0].max(initial=0.0))

    def without(self, node: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(value, weight) of words had a document of this grade not been clamped to it."""
        n, s, q = np.maximum(self.n[node] - 1, 0), self.s[node] - grade, np.maximum(self.q[node] - grade**2, 0)
        value = self._value(n, s)
        return value, self._weight(n, value, q)


def scores(nodes: Nodes, text: np.ndarray, node: np.ndarray, count: int, own: np.ndarray | None = None) -> np.ndarray:
    """Score of each text by its words; with ``own`` grades as if it had not been graded itself."""
    value, weight = (nodes.value[node], nodes.weight[node]) if own is None else nodes.without(node, own[text])
    return means(text, value, weight, count)


def places(by: dict[int, tuple[int, float]], grade: float, score: float, variance: float, covariance: float) -> np.ndarray:
    """Where each of LEVELS lies on the score scale: the median of its documents, drawn to the straight line through all of them.

    ``by`` has number and median score by level; the others are the moments of all graded documents.
    """
    slope = max(covariance / variance, 1e-3) if variance > 1e-9 else 1.0
    centre = []
    for k in LEVELS:
        n, m = by.get(k, (0, 0.0))
        centre.append((n * m + LINE * (score + slope * (k - grade))) / (n + LINE))
    return np.maximum.accumulate(centre)


def _flat(b: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, node) of the words of a batch, and its grades."""
    col = b.column("words")
    count = np.diff(col.offsets.to_numpy())
    node = col.flatten().to_numpy().view(np.uint32) & np.uint32(size - 1)
    return np.repeat(np.arange(len(count)), count), node.astype(np.int64), b.column("grade").to_numpy(zero_copy_only=False).astype(float)


def _blocks(sums: np.ndarray) -> pa.RecordBatch:
    """(block, its sums as bytes) of the blocks of nodes that are not all 0."""
    v = sums.reshape(len(sums), -1, BLOCK).transpose(1, 0, 2)
    at = np.flatnonzero(v.any(axis=(1, 2)))
    return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([v[i].tobytes() for i in at], pa.binary())], ["block", "sums"])


def reading_levels(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", grade: str = "grade") -> DataFrame:
    """``doc_id, score, level`` of every document: a continuous difficulty and the level of LEVELS nearest to it.

    Graded documents are clamped to the median of their distinct grades by rater (null grades and grades outside LEVELS
    are ignored); a word takes the mean of its documents, a document the mean of its words weighted by how sharply
    they mark a level, and the values of ungraded documents flow back with weight FREE. The weights are learnt in the first
    rounds; then the harmonic iteration runs until no word's value changes by more than TOLERANCE (or ROUNDS). Each round is one
    pass over the words of all documents, hashed once from whole texts and kept as a table. The borders lie halfway between the levels' places,
    which come from the scores of the graded documents, each taken as if it had no grade.
    Null texts and texts without a word get a null score and level. Repeated rows give repeated results. Extra columns
    are dropped. Without any grades all levels are null.
    """
    sc = docs.sparkSession.sparkContext
    g = labels.select(F.col(doc_id).cast("string").alias("gd"), "rater", F.col(grade).alias("grade")).where(F.col("grade").between(LEVELS[0], LEVELS[-1]) & F.col("gd").isNotNull())
    g = g.distinct().groupBy("gd").agg(F.median("grade").cast("double").alias("grade"))
    kind = docs.schema[doc_id].dataType
    d = spread(docs.select(F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t")))  # ids pass as text, exact

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            count, h = words(b.column("t").to_pylist())
            few = h % COUNTED == 0
            row = np.repeat(np.arange(len(count)), count)
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(x.view(np.int32))) for n, x in ((count, h), (np.bincount(row[few], minlength=len(count)), h[few]))]
            yield pa.RecordBatch.from_arrays([b.column("d"), *lists], ["d", "words", "few"])

    table = d.mapInArrow(hashed, "d string, words array<int>, few array<int>")
    table = materialize(table.join(g, F.col("d") == F.col("gd"), "left").select("d", "words", "few", "grade"), "reading-words")
    want = NODES * COUNTED * table.select(F.explode("few").alias("w")).distinct().count()
    size = min(MOST, max(FEWEST, 1 << max(want - 1, 1).bit_length()))
    few_tasks = table.select("words", "grade").coalesce(2 * sc.defaultParallelism)

    def gather(state: object, learn: bool):  # noqa: ANN202
        """Sums over documents by word: weight, value, squared value; when no longer learning the value only. A row has a block of nodes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((3 if learn else 1, size))
            for b in batches:
                t, x, y = _flat(b, size)
                weight = np.where(np.isnan(y), FREE if state else 0.0, 1.0)
                if state:
                    y = np.where(np.isnan(y), scores(state.value, t, x, len(y)), y)
                weight[np.isnan(y)] = 0.0
                y = np.nan_to_num(y)
                for acc, v in zip(sums, (weight, weight * y, weight * y * y) if learn else (weight * y,), strict=True):
                    acc += np.bincount(x, weights=v[t], minlength=size)
            yield _blocks(sums)

        return run

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of the rows of each block."""
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for at, x in zip(b.column("block").to_pylist(), b.column("sums").to_pylist(), strict=True):
                v = np.frombuffer(x)
                acc[at] = acc[at] + v if at in acc else v
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([v.tobytes() for v in acc.values()], pa.binary())], ["block", "sums"])

    def summed(df: DataFrame, state: object, learn: bool) -> np.ndarray:
        part = df.mapInArrow(gather(state, learn), "block int, sums binary").repartition("block").mapInArrow(added, "block int, sums binary")
        rows = part.toArrow()
        out = np.zeros((3 if learn else 1, size // BLOCK, BLOCK))
        for at, x in zip(rows["block"].to_pylist(), rows["sums"].to_pylist(), strict=True):
            out[:, at] = np.frombuffer(x).reshape(-1, BLOCK)
        return out.reshape(-1, size)

    nodes = Nodes(*summed(few_tasks.where("grade is not null"), None, True))
    state = sc.broadcast(nodes)
    for i in range(ROUNDS):
        learn = i < LEARN
        got = summed(few_tasks, state, learn)
        if learn:
            nodes = Nodes(*got)
            left = np.inf
        else:
            left = nodes.moved(got[0])
        state.unpersist()
        state = sc.broadcast(nodes)
        if left <= TOLERANCE:
            break

    def score(loo: bool):  # noqa: ANN202
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                t, x, y = _flat(b, size)
                v = scores(state.value, t, x, len(y), y if loo else None)
                yield pa.RecordBatch.from_arrays([b.column("d"), b.column("grade"), pa.array(v, from_pandas=True)], ["d", "grade", "score"])

        return run

    shape = "d string, grade double, score double"
    graded = materialize(table.where("grade is not null").mapInArrow(score(True), shape).where("score is not null"), "reading-graded")
    level = F.floor("grade").alias("k")
    by = graded.groupBy(level).agg(F.median("score").alias("m"), F.count(F.lit(1)).alias("n")).collect()  # one row a level
    line = graded.agg(F.avg("grade").alias("g"), F.avg("score").alias("s"), F.var_pop("grade").alias("v"), F.covar_pop("grade", "score").alias("c")).first()
    out = table.mapInArrow(score(False), shape)
    level = F.lit(None)
    if by:
        centre = places({int(r["k"]): (r["n"], r["m"]) for r in by}, line["g"], line["s"], line["v"], line["c"])
        borders = (centre[1:] + centre[:-1]) / 2
        level = F.when(F.col("score").isNotNull(), F.lit(LEVELS[0]) + sum((F.col("score") >= F.lit(float(x))).cast("int") for x in borders))
    else:
        out = out.withColumn("score", F.lit(None).cast("double"))
    return out.select(F.col("d").cast(kind).alias(doc_id), "score", level.cast("int").alias("level"))
