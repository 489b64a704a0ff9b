import contextlib
import itertools
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestream.llm import capping, duplicates, setjoin
from lodestream.llm.capping import cap_contributors, usable_judgments
from lodestream.llm.duplicates import cross_split_pairs, duplicate_pairs, near_duplicates, split_class
from lodestream.llm.queries import oracle_sql, queries
from lodestream.llm.textkeys import canonical, pieces
from lodestream.session import table
from tests.compare import both
from tests.conftest import DATA

ROWS = "contributor string, pair_id string, q double, c int, bin int, kept string"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, name):
    got, want = both(spark, queries()[name], oracle_sql()[name], DATA)
    assert got == want


def ranked(rows, limit):
    """Brute force: kept flags by contributor."""
    out = []
    key = lambda r: (-(r[2] if r[2] is not None and r[2] == r[2] else -1e9), r[1] is None, r[1] or "")
    for c, group in itertools.groupby(sorted(rows, key=lambda r: (r[0] is None, r[0] or "")), key=lambda r: r[0]):
        for i, r in enumerate(sorted(group, key=key)):
            out.append((c, r[1], c is None or i < limit))
    return sorted(out, key=str)


@pytest.mark.parametrize(("limit", "salts", "bins"), [(3, 4, 10), (1, 1, 1), (7, 32, 1000), (0, 4, 10)])
def test_capping_equals_brute_force(spark, limit, salts, bins):
    rnd = random.Random(limit)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", "c", None]), rnd.choice([f"p{i:04}", None, "same"]), rnd.choice([rnd.random(), 0.5, None, float("nan"), 2.0, -1.0]), 1, 2, "x") for i in range(400)]
    df = spark.createDataFrame(rows, ROWS)
    got = cap_contributors(df, "contributor", "pair_id", "q", max_count=limit, salts=salts, bins=bins)
    want = ranked(rows, limit)
    assert sorted(((r[0], r[1], r[3]) for r in got.collect()), key=str) == want


def test_capping_by_ranges_equals_brute_force(spark, monkeypatch):
    """All of one quality, so that the cutoff bin holds whole contributors."""
    monkeypatch.setattr(capping, "LEADERS", 0)
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot", "hot", "hot", "b", None]), f"p{rnd.randrange(250):04}", rnd.choice([0.5, 0.5, 0.5, 0.9]), 1, 2, "x") for _ in range(500)]
    got = cap_contributors(spark.createDataFrame(rows, ROWS), "contributor", "pair_id", "q", max_count=90, salts=3)
    assert sorted(((r[0], r[1], r[3]) for r in got.collect()), key=str) == ranked(rows, 90)


def test_capping_by_share_and_empty(spark):
    df = spark.createDataFrame([("a", f"p{i}", i / 10, 0, 0, "") for i in range(8)] + [("b", "x", 1.0, 0, 0, ""), ("b", "y", 1.0, 0, 0, "")], ROWS)
    got = cap_contributors(df, "contributor", "pair_id", "q", max_share=0.3)
    assert {r["pair_id"] for r in got.where("kept").collect()} == {"p7", "p6", "p5", "x", "y"}
    assert cap_contributors(df.where("false"), "contributor", "pair_id", "q", max_count=3).count() == 0
    with pytest.raises(ValueError, match="max_count"):
        cap_contributors(df, "contributor", "pair_id", "q")


def test_usable_judgments(spark):
    rows = [("p", " A　", "ok", 1, 0.4), ("p", "a", "ok", 2, 0.3), ("q", "b", "ok", 1, float("nan")), ("r", "b", "ok", 1, 1.5), ("s", "b", "api_error", 1, 0.5), (None, "b", "ok", 1, 0.5), ("t", None, "ok", 1, 0.5), ("u", "b", "ok", 1, None)]
    df = spark.createDataFrame(rows, "pair_id string, source_id string, status string, n int, c double").selectExpr("pair_id", "source_id", "status", "timestamp_seconds(n) created_at", "timestamp_seconds(n) loaded_at", "named_struct('confidence', c) parsed_judgment")
    assert {tuple(r) for r in usable_judgments(df).collect()} == {("p", "a", 0.3), ("t", None, 0.5)}


def reworked(rnd, text):
    """A copy with small edits, a moved part, or an insertion."""
    t = list(text)
    for _ in range(rnd.randint(0, 4)):
        i = rnd.randrange(len(t))
        t[i : i + rnd.randint(0, 2)] = rnd.choices("甲乙丙丁戊abcd", k=rnd.randint(0, 3))
    if rnd.random() < 0.4:
        i, j, k = sorted(rnd.sample(range(len(t)), 3))
        t = t[:i] + t[j:k] + t[i:j] + t[k:]
    return "".join(t)


def corpus(seed, n=70):
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("一二三四五六七八九十天地人你我他", k=rnd.randint(3, 7))) for _ in range(60)]
    base = ["，".join(rnd.choices(words, k=rnd.randint(3, 40))) for _ in range(n)]
    out = base + [reworked(rnd, rnd.choice(base)) for _ in range(2 * n)] + [base[0]] * 5
    out += ["", None, "。。", "甲", "甲乙丙丁", "甲乙丙丁戊", "甲乙丙丁戊", "abc" * 3000, "abc" * 3000 + "x", "a" * 50]
    rows = [(f"s{i:04}", t, rnd.choice(["train", " Train", "TEST", "dev", "valid", None, "other"]), f"f{i % 3}") for i, t in enumerate(out)]
    return rows + rows[:10] + [(None, base[0], "train", "f"), ("s0001", "完全不同的另一个文本而已呀", "test", "f")]


FRAME = "source_id string, case_text string, split string, source_file string, id string, ckey string, canon string"


def brute(rows, t=0.5):
    texts = {(s, canonical(x)) for s, x, *_ in rows if s is not None and canonical(x)}
    grams = {c: pieces(c, 5) for _, c in texts}
    out = set()
    for (s, x), (u, y) in itertools.combinations(sorted(texts), 2):
        g, h = grams[x], grams[y]
        if s != u and (x == y or (g and h and len(g & h) >= t * len(g | h))):
            out.add((min(s, u), max(s, u)))
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rows = corpus(1)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FRAME)
    want = brute(rows)
    assert len(want) > 100
    got = duplicate_pairs(df)
    assert {tuple(r) for r in got.collect()} == want
    assert got.count() == len(want)
    high = {tuple(r) for r in duplicate_pairs(df, t=0.8).collect()}
    assert high == brute(rows, 0.8)


def test_cross_split_equals_brute_force(spark):
    rows = corpus(2)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FRAME)
    cls = {}
    for s, _, sp, _ in rows:
        k = (sp or "").strip().lower()
        cls.setdefault(s, set()).add("train" if k == "train" else "eval" if k in ("test", "dev", "valid") else None)
    sides = {}
    for s, x, sp, _ in rows:
        k = (sp or "").strip().lower()
        c = "train" if k == "train" else "eval" if k in ("test", "dev", "valid") else None
        if s and canonical(x) and c:
            sides.setdefault(c, set()).add((s, canonical(x)))
    want = set()
    for (s, x), (u, y) in itertools.product(sides["train"], sides["eval"]):
        g, h = pieces(x, 5), pieces(y, 5)
        if s != u and (x == y or (g and h and 2 * len(g & h) >= len(g | h))):
            want.add((min(s, u), max(s, u)))
    got = {tuple(r) for r in cross_split_pairs(df).collect()}
    assert len(want) > 30 and got == want


def test_empty_and_split_names(spark):
    df = spark.createDataFrame([], FRAME)
    assert duplicate_pairs(df).count() == 0 and cross_split_pairs(df).count() == 0
    m, p = near_duplicates(df)
    assert m.count() == 0 and p.count() == 0
    names = spark.createDataFrame([(x,) for x in ("train", "TRAINING", " val ", "Validation", "dev", "test", "testing", None, "x")], "s string")
    assert [r[0] for r in names.select(split_class(F.col("s"))).collect()] == ["train", "train", "validation", "validation", "validation", "test", "test", None, None]


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    mark = lambda v: np.frombuffer(setjoin.sketches(np.zeros(len(v), dtype=np.int64), v, np.array([len(v)]))[0].as_py(), dtype=np.uint64)
    for n in (3, 100, 200, 500, 3000):
        a = rng.integers(0, 2**52, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], rng.integers(0, 2**52, n // 2).astype(np.uint64)])
        x, y = (mark(np.unique(v)) for v in (a, b))
        while len(x) > len(y):
            x = x[: len(x) // 2] ^ x[len(x) // 2 :]
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        assert np.bitwise_count(x ^ y).sum() <= len(set(a) ^ set(b))


class Captured:
    """Stands for a table and keeps the function that it is mapped with."""

    def count(self):
        return 0

    def select(self, *_):
        return self

    def mapInArrow(self, function, _):  # noqa: N802
        self.function = function
        raise StopIteration


def test_counting_costs_no_table_a_run(monkeypatch):
    """the large table of a large corpus was made anew for each run of texts."""
    monkeypatch.setattr(setjoin, "FEWEST", 1 << 23)
    texts = ["甲乙丙丁戊己", "甲乙丙丁戊", "", "甲乙丙丁戊甲乙丙丁戊"]
    df = Captured()
    with contextlib.suppress(StopIteration):
        setjoin.bucket_counts(df)
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array([0, 0, 1, 1], pa.int8())], ["canon", "role"])
    tracemalloc.start()
    got = pa.Table.from_batches(df.function(iter([batch, batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    counts = sorted(got["n"].to_pylist())
    assert counts == [2] * 6 + [4] and got["b"].to_pylist() == sorted(set(got["b"].to_pylist()))
    assert peak < 1.2 * 2 * (1 << 23) * 4


def test_folded_sketches_in_any_order():
    rng = np.random.default_rng(2)
    n = np.array([100, 700, 200, 3, 500, 3000, 160, 161])
    h = rng.integers(0, 2**52, n.sum()).astype(np.uint64)
    marks = setjoin.sketches(np.repeat(np.arange(len(n)), n), h, n)
    for part in (slice(0, 8), slice(2, 7), slice(3, 4)):
        order = rng.permutation(len(n[part]))
        kind, words = setjoin._folded(marks[part], order)
        assert kind.tolist() == np.searchsorted(setjoin.SIZES, n[part][order]).tolist()
        for i, mark in enumerate(np.array(marks[part].to_pylist(), dtype=object)[order]):
            want = np.frombuffer(mark, dtype=np.uint64)
            for k in range(kind[i], -1, -1):
                assert words[k][:, i].tolist() == want.tolist()
                want = want[: len(want) // 2] ^ want[len(want) // 2 :]


def test_short_lists_and_occurrences():
    """The more it costs to probe a list, the fewer are left to probe; T - L never falls with the size of a text."""
    n = np.arange(1, 400)
    for ratio in (1.0, 1.14, 2.0):
        short, want = setjoin.short_lists(n, 0.5, ratio)
        least = np.ceil(n / 2)
        assert (want >= 1).all() and (np.diff(want) >= 0).all() and (short == n - (least - want)).all()
    assert (setjoin.short_lists(n, 0.5, 1.0)[1] == 1).all() and setjoin.short_lists(n, 0.5, 1.14)[1][110] > 5
    assert setjoin.cost_ratio(10**6) > setjoin.cost_ratio(10) > 1


@pytest.mark.parametrize("mu", [0.0, 0.05])
def test_any_number_of_probed_lists_gives_all_pairs(spark, monkeypatch, mu):
    monkeypatch.setattr(setjoin, "MU", mu)
    rows = corpus(4)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FRAME)
    assert {tuple(r) for r in duplicate_pairs(df).collect()} == brute(rows)


def test_large_classes_in_blocks(spark, monkeypatch):
    rows = corpus(6)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FRAME)
    want = {tuple(r) for r in cross_split_pairs(df).collect()}
    monkeypatch.setattr(duplicates, "BLOCK", 2)
    got = duplicate_pairs(df)
    assert {tuple(r) for r in got.collect()} == brute(rows) and got.count() == len(brute(rows))
    assert {tuple(r) for r in cross_split_pairs(df).collect()} == want


def test_links_query(spark):
    x = queries()["p2_links"](spark, DATA)
    ids = table(spark, DATA, "candidate").where("case_text is not null").select("source_id").distinct().count()
    assert x.count() == ids and x.where("copies < 1 or links < 0").count() == 0


def test_banded_distance():
    rnd = random.Random(9)

    def full(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for _ in range(400):
        a, b = ("".join(rnd.choices("ab甲", k=rnd.randint(0, 12))) for _ in range(2))
        for k in (0, 1, 3, 20):
            d = full(a, b)
            assert setjoin.banded_distance(a, b, k) == (d if d <= k else None)


def split_frame(spark, rows):
    return spark.createDataFrame([(*r, "f", "x", "y", "z") for r in rows], FRAME)


def test_cross_split_deleted_stretches(spark):
    e = "".join(chr(0x4E00 + i) for i in range(47))
    df = split_frame(spark, [("e", e, "test"), ("t", e[:8] + e[12:28] + e[32:], "train")])
    assert {tuple(r) for r in cross_split_pairs(df).collect()} == {("e", "t")}


def stretches(rnd, text):
    """A copy near Jaccard 0.5: stretches of 4 or 5 characters, some 20 apart, deleted, replaced or moved."""
    out, at = [], rnd.randint(4, 12)
    out.append(text[:at])
    while at < len(text):
        n, kind = rnd.choice([4, 4, 5]), rnd.choice(["delete", "delete", "delete", "replace", "move"])
        part, at = text[at : at + n], at + n
        step = rnd.randint(15, 20)
        keep, at = text[at : at + step], at + step
        out += {"delete": [keep], "replace": ["".join(chr(0x8000 + rnd.randrange(4000)) for _ in part), keep], "move": [keep, part]}[kind]
    return "".join(out)


def test_cross_split_equals_duplicates_near_the_border(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(600):
        e = "".join(chr(0x4E00 + rnd.randrange(6000)) for _ in range(rnd.randint(40, 130)))
        rows += [(f"e{i}", e, rnd.choice(["test", "dev"])), (f"t{i}", stretches(rnd, e), "train")]
    df = split_frame(spark, rows)
    side = {r[0]: r[2] == "train" for r in rows}
    want = {tuple(r) for r in duplicate_pairs(df).collect() if side[r[0]] != side[r[1]]}
    assert len(want) > 100
    assert {tuple(r) for r in cross_split_pairs(df).collect()} == want


def test_cross_split_in_blocks(spark, monkeypatch):
    rows = corpus(3)
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FRAME)
    whole = {tuple(r) for r in cross_split_pairs(df).collect()}
    monkeypatch.setattr(setjoin, "BLOCK", 8)
    assert len(whole) > 30 and {tuple(r) for r in cross_split_pairs(df).collect()} == whole


def test_cross_split_short_text_in_repeats(spark):
    e = "".join(chr(0x4E00 + i) for i in range(30))
    df = split_frame(spark, [("e", e, "test"), ("t", e * 3, "train")])
    assert {tuple(r) for r in duplicate_pairs(df).collect()} == {("e", "t")}
    assert {tuple(r) for r in cross_split_pairs(df).collect()} == {("e", "t")}
