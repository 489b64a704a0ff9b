"""Mixing sources to target weights by balanced sampling with the cube method."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.capping import normalized_id
from lodestream.session import broadcast_within, materialize, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: GPT-2 style splitting of text before byte-pair merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents in one block of the flight phase.
BLOCK = 512
#: Sources whose plan is sent to all executors; with more of them it is joined by shuffle.
FEW_SOURCES = 100_000


def token_counts(docs: DataFrame, doc_id: str, source: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, tokens``: number of tokens of each whole text (null text: 0). The vocabulary is sent to the executors as a file."""
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = tokenizer.rsplit("/", 1)[-1]
    src = spread(docs.select(F.col(doc_id).alias("d"), normalized_id(F.col(source)).alias("s"), F.col(text).alias("t")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(SparkFiles.get(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        enc = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"d": b["d"], "s": b["s"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["t"]]})

    kind = src.schema["d"].dataType.simpleString()
    return src.mapInPandas(run, f"d {kind}, s string, tokens bigint").select(F.col("d").alias(doc_id), F.col("s").alias(source), "tokens")


def plan_mix(sizes: DataFrame, targets: DataFrame, total: float | None = None) -> list[dict]:
    """Per source: share, tokens, docs, limit of repeats and the wanted number of copies of each document.

    Target rows of one source (equal in lower case without outer white space) are one: the largest share and the smallest
    limit hold. Sources without a share, without documents or without tokens take no part; the shares of the others are
    scaled to 1. Without ``total`` the mix is as large as all of them can reach their shares within their limits, at most
    all tokens when none is limited. With a ``total`` beyond that, limited sources give all they may and the others fill
    up in proportion to their shares. Sources are few: one row each reaches the driver.
    """
    t = targets.select(normalized_id(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null and target_share > 0")
    t = t.groupBy("source").agg(F.max("target_share").alias("share"), F.min("max_repeats").alias("limit"))
    rows = [r.asDict() for r in t.join(sizes.where("tokens > 0"), "source").where("limit is null or limit > 0").collect()]
    whole = sum(r["share"] for r in rows)
    for r in rows:
        r["share"] /= whole
    most = {r["source"]: float("inf") if r["limit"] is None else float(r["limit"] * r["tokens"]) for r in rows}
    if total is None:
        caps = [most[r["source"]] / r["share"] for r in rows if r["limit"] is not None]
        total = min(caps) if caps else float(sum(r["tokens"] for r in rows))
    give, open_, rest = {}, list(rows), float(total)
    while open_:
        part = sum(r["share"] for r in open_)
        full = [r for r in open_ if r["share"] / part * rest > most[r["source"]]]
        for r in full or open_:
            give[r["source"]] = most[r["source"]] if full else r["share"] / part * rest
        rest -= sum(give[r["source"]] for r in full)
        open_ = [r for r in open_ if r not in full] if full else []
    for r in rows:
        r["copies"] = give[r["source"]] / r["tokens"]
        if r["limit"] is not None:
            r["copies"] = min(r["copies"], float(r["limit"]))
    return rows


def flight(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Cube method, flight phase: move inclusion probabilities along the null space of the constraints until at most two are fractional.

    Constraints are the expected number of documents and of tokens; both keep their value at each step.
    """
    p = pi.astype(float).copy()
    eps = 1e-9
    open_ = [i for i in range(len(p)) if eps < p[i] < 1 - eps]
    rand = rng.random(len(open_) + 1)
    held, nxt, k = open_[:3], 3, 0
    while len(held) == 3:
        a, b, c = held
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])  # orthogonal to (1, 1, 1) and to the sizes
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for i, x in zip(held, u, strict=True):
            if x > 0:
                up, down = min(up, (1 - p[i]) / x), min(down, p[i] / x)
            elif x < 0:
                up, down = min(up, p[i] / -x), min(down, (1 - p[i]) / -x)
        step = up if rand[k % len(rand)] < down / (up + down) else -down
        k += 1
        for i, x in zip(held, u, strict=True):
            p[i] += step * x
        stay = []
        for i in held:
            if p[i] <= eps:
                p[i] = 0.0
            elif p[i] >= 1 - eps:
                p[i] = 1.0
            else:
                stay.append(i)
        held = stay
        while len(held) < 3 and nxt < len(open_):
            held.append(open_[nxt])
            nxt += 1
    return p


def land(pi: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Landing phase: of the 0/1 choices for the few documents left the one nearest in tokens, then in documents."""
    p = pi.copy()
    left = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
    best = min(range(1 << len(left)), key=lambda m: (abs(sum(((m >> k & 1) - p[i]) * size[i] for k, i in enumerate(left))), abs(bin(m).count("1") - p[left].sum()))) if len(left) else 0
    for k, i in enumerate(left):
        p[i] = best >> k & 1
    return p


def mix_sources(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", total: float | None = None, tokenizer: str = TOKENIZER, seed: int = 42, relative: bool = False) -> DataFrame:
    """``doc_id, source, tokens, copies`` of the mix: documents with at least one copy.

    ``total`` is the size in tokens, or with ``relative`` as a multiple of all tokens of ``docs``; without it the mix is as large as lets all sources reach their shares.

    Each document of a source gets the whole part of the wanted copies; the fraction is drawn by the cube method, which keeps
    the source's token and document totals. Blocks of at most BLOCK documents (by hash within a source, so no source
    is one task) fly on their own and leave two undecided documents each; these form new blocks, until one block a
    source is left to land. No document exceeds its source's limit. Null texts have 0 tokens and null sources no share. The
    same input and seed give the same mix. Rows with a null doc_id are left out; repeated doc_ids count as documents of their own.
    """
    spark: SparkSession = docs.sparkSession
    tok = materialize(token_counts(docs.where(F.col(doc_id).isNotNull()), doc_id, source, text, tokenizer).toDF("d", "source", "tokens"), "mix-tokens")
    if relative and total is not None:
        total *= float(tok.agg(F.sum("tokens")).first()[0] or 0)
    plan = plan_mix(tok.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")), targets, total)
    kind = tok.schema["d"].dataType.simpleString()
    if not plan:
        return tok.where("false").select(F.col("d").alias(doc_id), F.col("source").alias(source), "tokens", F.lit(0).alias("copies"))
    steps = spark.createDataFrame([(r["source"], int(r["copies"]), r["copies"] - int(r["copies"]), int(r["docs"])) for r in plan], "source string, whole int, part double, docs bigint")
    start = tok.join(broadcast_within(steps, FEW_SOURCES), "source").withColumn("p", F.when(F.col("part") > 1e-9, F.col("part")).otherwise(0.0))
    shape = f"d {kind}, source string, tokens bigint, whole int, p double"

    def fly(last: bool):  # noqa: ANN202
        def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
            b = b.sort_values(["tokens", "d"], kind="stable").reset_index(drop=True)
            rng = np.random.default_rng([seed, abs(hash_text(f"{key[0]}/{key[1]}"))])
            order = rng.permutation(len(b))
            size = b["tokens"].to_numpy(dtype=float)[order]
            p = flight(b["p"].to_numpy()[order], size, rng)
            if last:
                p = land(p, size, rng)
            out = np.empty(len(b))
            out[order] = p
            return b.assign(p=out)[["d", "source", "tokens", "whole", "p"]]

        return run

    done: list[DataFrame] = [start.where("p = 0").select("d", "source", "tokens", "whole", "p")]
    rest = start.where("p > 0").select("d", "source", "tokens", "whole", "p", "docs")
    left = max(r["docs"] for r in plan)
    level = 0
    while True:
        last = left <= BLOCK
        blocks = F.greatest(F.lit(1), F.ceil(F.col("docs") / (BLOCK // 2))) if not last else F.lit(1)
        keyed = rest.withColumn("block", F.pmod(F.xxhash64("d", F.lit(seed + level)), blocks).cast("bigint"))
        flown = materialize(keyed.drop("docs").groupBy("source", "block").applyInPandas(fly(last), shape), "mix-flight")
        if last:
            done.append(flown)
            break
        done.append(flown.where("p = 0 or p = 1"))
        rest = flown.where("p > 0 and p < 1")
        n = rest.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
        most = n.agg(F.max("docs")).first()[0] or 0
        rest = rest.join(broadcast_within(n, FEW_SOURCES), "source")
        left, level = most, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.withColumn("copies", F.col("whole") + F.col("p").cast("int")).where("copies > 0").select(F.col("d").alias(doc_id), F.col("source").alias(source), "tokens", "copies")


def hash_text(text: str) -> int:
    """A stable number for a text."""
    from zlib import crc32

    return crc32(text.encode())


def mix_shares(mix: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """``source, target_share, actual_share, tokens, docs, most_copies`` of a mix, for every source of the targets."""
    t = targets.select(normalized_id(F.col("source")).alias("source"), "target_share").where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    m = mix.groupBy(F.col(source).alias("source")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("docs"), F.max("copies").alias("most_copies"))
    m = materialize(m, "mix-sources")
    x = t.join(m, "source", "left").withColumn("whole", F.lit(m.agg(F.sum("tokens")).first()[0]).cast("double"))
    return x.select("source", "target_share", F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("actual_share"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tokens", "docs", "most_copies")])
