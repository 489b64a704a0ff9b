import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestream.llm import leaks, mixing
from lodestream.llm.defects import first_defect, label_model, language, response_defects
from lodestream.llm.leaks import leaked_items, template
from lodestream.llm.lookalike import SpellingTrie, consistent, consistent_spans, fold, hidden_spans, skeleton, spellings
from lodestream.llm.mixing import flight, land, mix_shares, mix_sources, plan_mix
from lodestream.llm.queries import queries
from lodestream.llm.reading import reading_levels
from lodestream.llm.textkeys import canonical, pieces
from lodestream.llm.truncation import is_empty, tail_state, truncated_values, truncation_rates
from lodestream.session import table
from tests.conftest import DATA

SENTENCES = ["饮食上少吃{}和{}，注意休息，避免活动过度。", "{}天后复查{}，必要时加做检查。", "请记录每次发作的时间和诱因，就诊时带给医生{}{}。"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("火锅 蛋糕 苹果 牛奶 豆腐 白菜".split())
    return ["".join(rnd.choice(SENTENCES).format(word(), word()) for _ in range(4)) for _ in range(n)]


def test_truncation(spark):
    full = texts(300)
    rows = [("f", f"k{i}", t, 0) for i, t in enumerate(full)]
    rows += [("f", f"c{i}", t[:-3], 0) for i, t in enumerate(texts(40, 2))]  # cut inside the last sentence
    rows += [("f", f"m{i}", t[:-1], 0) for i, t in enumerate(texts(40, 3))]  # only the closing mark is missing
    rows += [("f", f"e{i}", t + "祝好", 0) for i, t in enumerate(texts(40, 4))]
    rows += [("f", "bad", "饮食上少吃火�", 0), ("f", "n", None, 0), ("f", "z", " ", 0), ("f", "none", "N/A", 0), (None, None, full[0][:-4], 0), ("f", "long", full[0] * 20_000 + "饮食上少吃", 0)]
    df = spark.createDataFrame(rows, "grp string, key string, text string, h int")
    got = {tuple(r) for r in truncated_values(df.unionByName(df), "grp", "key", "text").collect()}
    keys = {k for _, k in got}
    assert {f"c{i}" for i in range(40)} <= keys and {"bad", "long"} <= keys
    assert not {k for k in keys if k and k[0] in "kme" and k != "key"} and not keys & {"n", "z", "none"}
    assert truncated_values(df.where("false"), "grp", "key", "text").count() == 0


def test_strict_prefix_of_a_longer_copy(spark):
    long = "独一无二的开头" + "".join(chr(0x5000 + i * 7 % 3000) for i in range(200)) + "。"
    df = spark.createDataFrame([("f", "a", long, ""), ("f", "b", long[:120], ""), ("f", "c", long[:-1], ""), ("f", "d", "短", ""), ("g", "e", "短的文本", "")], "field string, record_key string, text string, source string")
    assert {r[1] for r in truncated_values(df, "field", "record_key", "text").collect()} == {"b"}
    assert {(r["field"], r["values"], r["truncated"], r["rate"]) for r in truncation_rates(df).collect()} == {("f", 4, 1, 0.25), ("g", 1, 0, 0.0)}


def test_longer_copy_decides(spark):
    """Over tails that mostly end a sentence, for a long and a short value; only within the group."""
    head = lambda n, at: "".join(chr(at + i) for i in range(n))
    tail = "注意休息避免劳累按时复查血糖血压"
    rows = [("f", f"k{i}", f"{head(30, 0x6000 + 40 * i)}{tail}。") for i in range(8)]
    for name, n, at in (("long", 60, 0x5000), ("short", 12, 0x5100)):
        rows += [("f", name, head(n, at) + tail), ("f", f"{name}-copy", head(n, at) + tail + "以及心电图。")]
    rows += [("f", "other", head(60, 0x5200) + tail), ("g", "copy", head(60, 0x5200) + tail + "以及心电图。")]
    df = spark.createDataFrame(rows, "field string, record_key string, text string")
    assert {r[1] for r in truncated_values(df, "field", "record_key", "text").collect()} == {"long", "short"}


@pytest.mark.parametrize(("text", "state"), [("好。", "closed"), ("好。”", "closed"), ("Yes.", "closed"), ("值为3.", "open"), ("好", "open"), ("好…", "open"), ("……", "empty"), ("无", "empty"), ("N/A", "empty"), ("好�", "broken"), ("好，\n", "open")])
def test_tail_state(text, state):
    assert tail_state(text)[0] == state


def target_rows(spark, rows):
    return spark.createDataFrame(rows, "source_id string, a string, r string").select("source_id", F.struct(F.col("a").alias("final_answer"), F.col("r").alias("clinical_reasoning")).alias("target"), F.lit("x").alias("field"), F.lit("y").alias("votes"))


def test_defects(spark):
    good = texts(300)
    case = "患者男，四十岁，反复胸闷三天，活动后加重，伴有轻度头晕，家族中有人得高血压，请问需要做什么检查？"
    rows = [(f"s{i}", t, good[-1 - i]) for i, t in enumerate(good)]
    rows += [("e1", None, "　"), ("e2", "暂无", "N/A"), ("c1", case, "先复述一下：" + case), ("l1", "Please repeat the blood tests and avoid alcohol for two weeks.", "この症状は続いているので、専門の外来で検査を受けてください。")]
    rows += [(f"r{i}", "很抱歉，作为语言模型，我不能对您的健康问题作出回答。", "由于涉及医疗内容，此处不予作答，敬请谅解。") for i in range(6)] + [(f"t{i}", t[:-4], good[i]) for i, t in enumerate(texts(12, 9))]
    rows += [("nocase", good[0], good[1]), (None, good[2], "无")]
    ids = sorted({r[0] for r in rows if r[0] and r[0] != "nocase"})
    cand = spark.createDataFrame([(i, case, "v") for i in ids] + [(None, case, "v"), ("nocase", None, "v")], "source_id string, case_text string, votes string")
    both = response_defects(target_rows(spark, rows + rows[:5]), cand)
    got = {(r[0], r[1]): r[2] for r in first_defect(both).collect()}
    want = {("e1", "final_answer"): "empty", ("e1", "clinical_reasoning"): "empty", ("e2", "final_answer"): "empty", ("e2", "clinical_reasoning"): "empty", ("c1", "final_answer"): "copy", ("c1", "clinical_reasoning"): "copy", ("l1", "final_answer"): "language", ("l1", "clinical_reasoning"): "language", (None, "clinical_reasoning"): "empty"}
    want |= {(f"r{i}", f): "refusal" for i in range(6) for f in ("final_answer", "clinical_reasoning")} | {(f"t{i}", "final_answer"): "truncated" for i in range(12)}
    assert got == want
    assert response_defects(target_rows(spark, []), cand).count() == 0


def test_label_model_weighs_functions():
    post = label_model(np.array([[1, 1], [1, 0], [0, 0], [-1, -1]]), np.array([50.0, 5, 900, 10]))
    assert post[0] > 0.99 and post[2] < 0.01 and post[0] > post[1] > post[2] and post[3] < 0.2


@pytest.mark.parametrize(("text", "want"), [("胸闷三天，CT、MRI均正常", "zh"), ("The pain is in the left arm and it does not stop", "en"), ("Die Beschwerden sind nicht von der Hand zu weisen", "de"), ("Ces douleurs sont dans le bras et vous devez consulter", "fr"), ("この症状は続いています", "ja"), ("Такие жалобы держатся", "ru"), ("12.3", None)])
def test_language(text, want):
    assert language(text) == want
    assert is_empty(None)


def test_lookalikes(spark):
    assert fold("ＡΒ​С１㎎⽤é") == "ABC1mg用é"
    trie = SpellingTrie(["ABC", "mg", "café"])
    assert consistent("", trie) == "" and trie.find("А​ВС") == "ABC" and trie.find("㎎") == "mg" and trie.find("café") == "café" and trie.find("abc") is None
    assert trie.find("ABX", budget=1.0) == "ABC" and trie.find("AC", budget=1.0) == "ABC"
    case = "近7天胸闷，用过A药。 CREME样"
    spans = [("E1", "近７天​胸闷"), ("E2", "近7天胸闷"), ("E3", "creme样"), ("E4", "用过А药"), ("E5", "用过B药"), ("E6", None), ("E7", "​"), ("E8", ""), ("E9", "长" * 100_000), (None, "⽤过A药")]
    a = spark.createDataFrame([("s", {"evidence": spans}, "q"), ("t", {"evidence": None}, "q"), ("gone", {"evidence": spans}, "q"), (None, None, "q")], "source_id string, target struct<evidence:array<struct<id:string,span:string>>>, span string")
    c = spark.createDataFrame([("s", case, "z"), ("s", case, "z"), ("t", None, "z"), (None, case, "z")], "source_id string, case_text string, span string")
    assert {tuple(r) for r in hidden_spans(a, c).collect()} == {("s", "E1"), ("s", "E4"), ("s", None)}
    assert hidden_spans(a.where("false"), c).count() == 0


def test_vocabulary_decides_between_twins(spark):
    """l, I and 1, and O and 0 are left as they are by the table; the most frequent spelling of the corpus decides."""
    assert fold("HlNl") == "HlNl" and skeleton("HlNl") == skeleton("ＨINI") == skeleton("H1N1")
    rows = [("s", "既往感染H1N1，吸入CO2，1型，用药l0ml"), ("t", "曾有HINI感染，用药10ml，C02升高，10ml"), ("u", "H1N1阳性，CO2正常，只写一次的Ola")]
    c = spark.createDataFrame(rows, "source_id string, case_text string")
    words = spellings(c, "case_text")
    assert words == ["10ml", "CO2", "H1N1"]
    trie = SpellingTrie(words)
    assert consistent("Н​lＮ1与C０2，I型，OIa", trie) == "H1N1与CO2,I型,OIa"
    spans = [("E1", "HlNl"), ("E2", "I型"), ("E3", "Ｉ0ml"), ("E4", "co2"), ("E5", "H1N2")]
    a = spark.createDataFrame([("s", {"evidence": spans})], "source_id string, target struct<evidence:array<struct<id:string,span:string>>>")
    assert {tuple(r) for r in hidden_spans(a, c).collect()} == {("s", "E1"), ("s", "E3")}
    x = {r["evidence_id"]: r for r in consistent_spans(a, c).collect()}
    assert {k for k, r in x.items() if r["found_same"]} == {"E1", "E3"} and x["E1"]["span_same"] == "H1N1"


@pytest.mark.parametrize("most", [20_000, 0])
def test_leaks_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "BROADCAST_ITEMS", most)
    rnd = random.Random(6)
    qs = [f"患者{rnd.randint(20, 80)}岁，" + "".join(chr(0x4E00 + rnd.randrange(400)) for _ in range(60)) + f"，查CRP {rnd.randint(1, 99)}.{i}mg/L，下一步？" for i in range(20)]
    ds = ["".join(chr(0x4E00 + rnd.randrange(400)) for _ in range(80)) for _ in range(30)]
    ds += [ds[i] + q + ds[i + 1] for i, q in enumerate(qs[:8])] + [ds[i] + q[: len(q) // 3 * 2] for i, q in enumerate(qs[:8])] + [q[:20] for q in qs[:5]] + [None, "", "甲" * 200_000]
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(ds)] + [(None, None, "q"), (None, "甲乙", "q")], "doc_id bigint, text string, question string")
    items = spark.createDataFrame([(f"e{i}", q, "t") for i, q in enumerate(qs)] + [("e0", qs[0], "t"), ("n", None, "t"), ("z", "", "t"), (None, qs[0], "t"), ("short", "甲乙", "t")], "id string, question string, text string")
    want = set()
    for i, t in enumerate(ds):
        g = pieces(canonical(t), 8)
        want |= {(i, f"e{k}") for k, q in enumerate(qs) if 2 * len(g & (p := pieces(canonical(q), 8))) >= len(p)}
    out = leaked_items(docs, items, "doc_id", "text", "id", "question").where("whole >= 0.5")
    assert {(r["doc_id"], r["id"]) for r in out.collect()} == want and len(want) >= 16
    assert leaked_items(docs.where("false"), items, "doc_id", "text", "id", "question").count() == 0
    assert leaked_items(docs, items.where("false"), "doc_id", "text", "id", "question").count() == 0


def test_lookalike_letters_of_other_scripts():
    assert fold("кρναικɡɑı") == "kpvaikgai"


@pytest.mark.parametrize("most", [20_000, 1])
def test_leaks_without_a_common_template_window(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "BROADCAST_ITEMS", most)
    digits = "31415926535897932384"
    docs = spark.createDataFrame([(1, f"见{digits}mg。"), (2, f"前{digits}后"), (3, "31415926其他"), (4, "甲乙丙丁戊己庚辛壬癸子丑")], "doc_id bigint, text string")
    items = spark.createDataFrame([("short", digits + "mg"), ("half", digits + "甲乙丙丁戊己庚辛壬癸子丑"), ("other", "完全不同的另一个题目文本")], "id string, question string")
    got = leaked_items(docs, items, "doc_id", "text", "id", "question").where("whole >= 0.5")
    assert {(r["doc_id"], r["id"]) for r in got.collect()} == {(1, "short"), (2, "short"), (1, "half"), (2, "half")}


def test_slots_must_be_replaced_consistently(spark):
    """A re-parameterised copy puts one value wherever the item has one; other numbers in another order are no copy of it."""
    q = "张先生36岁，血压150mmHg，服药后血压150mmHg，心率88次，体温36度，张先生现在最应该做的检查是哪一项"
    fits = q.replace("张先生", "李女士").replace("36", "51").replace("150", "170").replace("88", "90")
    not_fits = q.replace("36岁", "51岁").replace("服药后血压150", "服药后血压120").replace("150mmHg，服", "170mmHg，服")
    docs = spark.createDataFrame([(1, "题目：" + fits), (2, not_fits)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["kind"] for r in leaked_items(docs, spark.createDataFrame([("e", q)], "id string, question string"), "doc_id", "text", "id", "question", share=0.99).collect()}
    assert got == {1: "reparameterised"}
    assert template("张某某36岁查wbc11mg") == ("@#岁查@#~", ["张某某", "36", "wbc", "11mg"])


def test_reparameterised_question(spark):
    q = "患者41岁，总觉得下颌角瘙痒五年，肛周连着胸骨后都钝痛，偶有大便不成形，体检RF 100.7ng/mL，血压123/95mmHg，既往有心房颤动15年，对判断预后最有价值的指标是"
    other = q
    for a, b in (("41", "63"), ("100.7", "88.2"), ("123/95", "141/70"), ("15", "9")):
        other = other.replace(a, b)
    docs = spark.createDataFrame([(1, other)], "doc_id bigint, text string")
    got = leaked_items(docs, spark.createDataFrame([("e", q)], "id string, question string"), "doc_id", "text", "id", "question", share=0.95).collect()
    assert [r["kind"] for r in got] == ["reparameterised"] and got[0]["slots"] < 1
    assert template("rf1007ngml血压") == ("@#~血压", ["rf", "1007ngml"])


def test_flight_keeps_totals():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 3, 50, 400):
        pi, size = rng.random(n), rng.integers(0, 900, n).astype(float)
        p = flight(pi, size, rng)
        assert abs(p.sum() - pi.sum()) < 1e-6 and abs((p * size).sum() - (pi * size).sum()) < 1e-3
        assert ((p > 1e-9) & (p < 1 - 1e-9)).sum() <= 2
        q = land(p, size, rng)
        assert set(q) <= {0.0, 1.0} and abs((q * size).sum() - (pi * size).sum()) <= 900
    assert set(flight(np.full(40, 0.5), np.full(40, 7.0), rng)) <= {0.0, 0.5, 1.0}


def test_plan_fills_up(spark):
    sizes = spark.createDataFrame([("a", 100, 10), ("b", 1000, 10), ("c", 0, 3)], "source string, tokens bigint, docs bigint")
    t = spark.createDataFrame([(" A", 0.5, 1), ("a", 0.5, 2), ("b", 0.5, None), ("c", 0.2, None), ("d", 0.2, None), (None, 1.0, None), ("b", None, 3)], "source string, target_share double, max_repeats int")
    got = {r["source"]: (r["share"], round(r["copies"], 6)) for r in plan_mix(sizes, t)}
    assert got == {"a": (0.5, 1.0), "b": (0.5, 0.1)}
    assert {r["source"]: round(r["copies"], 6) for r in plan_mix(sizes, t, total=600)} == {"a": 1.0, "b": 0.5}


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 32)
    rnd = random.Random(8)
    rows = [(i, rnd.choice(["A ", "a", "a", "b", None]), None if i % 50 == 0 else "字" * rnd.randint(1, 60), 1) for i in range(900)] + [(1, "a", "字", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens int")
    t = spark.createDataFrame([("a", 0.4, 2), ("B", 0.6, 3)], "source string, target_share double, max_repeats int")
    mix = mix_sources(docs, t)
    got = mix.toPandas()
    assert got[got["source"] == "a"]["copies"].max() <= 2 and got["copies"].max() <= 3 and set(got["source"]) == {"a", "b"}
    assert {r["source"]: round(r["actual_share"], 2) for r in mix_shares(mix, t).collect()} == {"a": 0.4, "b": 0.6}
    full = {r["source"]: r for r in mix_shares(mix_sources(docs, t, total=2.0, relative=True), t).collect()}
    assert full["a"]["most_copies"] == 2 and full["b"]["most_copies"] == 3
    again = mix_sources(docs.repartition(7), t).toPandas()
    assert sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, again.values.tolist()))
    assert mix_sources(docs.where("false"), t).count() == 0 and mix_sources(docs, t.where("false")).count() == 0


def test_reading_levels(spark):
    easy, hard = "小手要洗干净，每天早点睡。多喝水，少吃糖。", "条件性敲除后通路磷酸化水平下降，敏感性分析采用贝叶斯层次模型。"
    rows = [(i, (easy if i % 2 else hard) * (1 + i % 3), 9) for i in range(400)] + [(1000, None, 9), (1001, "", 9), (1002, "？？", 9), (1003, hard * 20_000, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, grade int")
    labels = spark.createDataFrame([(i, "r1", 1 if i % 2 else 5) for i in range(120)] + [(0, "r2", None), (2, "r1", 9), (4, "r1", 5), (None, "r1", 3), (7777, "r1", 3)], "doc_id bigint, rater string, grade int")
    got = {r["doc_id"]: r["level"] for r in reading_levels(docs, labels).collect()}
    assert all(got[i] == (1 if i % 2 else 5) for i in range(400)) and got[1003] == 5
    assert got[1000] is None and got[1001] is None and got[1002] is None
    assert {r["level"] for r in reading_levels(docs, labels.where("false")).collect()} == {None}
    assert reading_levels(docs.where("false"), labels).count() == 0


def test_reading_levels_on_held_out_grades(spark):
    """Documents graded by several raters, their grades withheld, get the agreed level nearly always."""
    d = DATA.replace("0.001", "0.1")
    labels, docs = table(spark, d, "reading_label"), table(spark, d, "documents")
    agreed = labels.where("grade is not null").select("doc_id", "rater", "grade").distinct().groupBy("doc_id").agg(F.min("grade").alias("lo"), F.max("grade").alias("hi"), F.count("*").alias("n")).where("lo = hi and n > 1")
    out = reading_levels(docs, labels.join(agreed, "doc_id", "left_anti")).join(agreed, "doc_id")
    n, ok = out.count(), out.where("level = lo").count()
    assert n >= 100 and ok >= 0.95 * n


@pytest.mark.parametrize("name", [n for n in queries() if not n.startswith(("p1_", "p2_", "p4_"))])
def test_queries_run(spark, name):
    df = queries()[name](spark, DATA)
    assert df.count() == df.distinct().count()
