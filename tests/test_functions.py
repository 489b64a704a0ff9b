import random

import pytest
from pyspark.sql import functions as F

from lodestream.functions import arrays as A
from lodestream.functions import hashing as H
from lodestream.functions import jsonx, stats
from lodestream.functions import text as T
from lodestream.operators import audit, chat, evaluation, joins, masking, pairs, preference, prompts, records, retrieval, risk, sampling


def one(spark, expr, **cols):
    row = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "keys", "kind", "want"),
    [
        ("D", "ABCDE", "单项选择题", ("D", "exact")),
        ("D. 共5对鳃弓", "ABCDE", "单项选择题", ("D", "leading_option")),
        ("分析略。最终答案：A、C、D", "ABCDE", "多项选择题", ("ACD", "answer_pattern")),
        ("A项似乎合理，但B项也可能。", "ABCDE", "单项选择题", (None, "no_answer_pattern")),
        ("答案：AC", "ABCDE", "单项选择题", (None, "multiple_for_single")),
        ("", "ABCDE", "单项选择题", (None, "empty")),
        (None, "ABCDE", None, (None, "empty")),
        ("答案：A。不对，答案：B", "ABCDE", "单项选择题", ("B", "answer_pattern")),
        ("先看症状\nB\n以上为分析", "ABCDE", "单项选择题", ("B", "answer_pattern")),
        ("选B为宜", "ABCDE", "单项选择题", (None, "no_answer_pattern")),
        ("选项：B和D", "ABCDE", "多项选择题", ("BD", "answer_pattern")),
        ("（B、D）", "ABCDE", "单项选择题", (None, "multiple_for_single")),
        ("最终答案是 f", "ABCDE", "单项选择题", (None, "no_answer_pattern")),
    ],
)
def test_extract_choice(spark, text, keys, kind, want):
    got = one(spark, T.extract_choice(F.col("t"), F.col("k"), F.col("q")), t=text, k=keys, q=kind)
    assert (got["answer"], got["method"]) == want


def test_text(spark):
    assert one(spark, T.canonical(F.col("t")), t="ＡＢc，１ ２é甲。") == "abc12甲"
    assert one(spark, T.normalized_choice(F.col("t"), F.lit("ABCDE")), t="C、A、C") == "AC"
    assert one(spark, T.occurrences(F.col("t"), F.lit("aa")), t="aaaaa") == 2
    assert one(spark, T.occurrences(F.col("t"), F.lit("")), t="aaaaa") is None
    cat, rest = T.split_department(F.col("t"))
    assert (one(spark, cat, t="心内科：胸闷"), one(spark, rest, t="心内科：胸闷")) == ("心内科", "胸闷")
    assert (one(spark, cat, t="胸闷"), one(spark, rest, t="胸闷")) == (T.NO_CATEGORY, "胸闷")
    assert one(spark, T.answer_text(F.col("t")), t="x<answer> 5\n</answer>y") == "5"
    assert one(spark, T.format_reward(F.col("t")), t="<think>a</think> <answer>b</answer>") == 1.0
    spans = F.array(F.struct(F.lit(0).alias("span_start"), F.lit(3).alias("span_end")), F.struct(F.lit(4).alias("span_start"), F.lit(6).alias("span_end")))
    assert one(spark, T.delete_spans(F.col("t"), spans), t="有咳嗽，发热，三天。") == "三天。"


def test_json(spark):
    cases = {'```json\n{"b": 1, "a": "}"}\n```': '{"a":"}","b":1}', 'x {"a": {"b": 2}} y {': '{"a":{"b":2}}', "none": None, "{bad} {\"a\": 1}": None}
    for text, want in cases.items():
        assert one(spark, jsonx.first_object(F.col("t")), t=text) == want
    assert one(spark, jsonx.any_object(F.col("t")), t='{bad} {"a": 1}') == '{"a":1}'
    assert one(spark, jsonx.strict_object(F.col("t")), t='{"a": 1} x') is None
    assert one(spark, jsonx.json_equal(F.col("t"), F.lit('{"b":2,"a":1}')), t='{"a": 1, "b": 2}') is True


def test_stats(spark):
    row = spark.createDataFrame([(3, 10, 600, 700)], "a int, b int, c int, d int")
    p = row.select(stats.mcnemar_exact("a", "b").alias("e"), stats.mcnemar("c", "d").alias("n")).first()
    assert abs(p["e"] - 0.0922851) < 1e-6 and abs(p["n"] - 0.0060286) < 1e-4
    low, high = stats.wilson(F.col("a"), F.col("b"))
    w = row.select(low.alias("l"), high.alias("h")).first()
    assert abs(w["l"] - 0.107789) < 1e-5 and abs(w["h"] - 0.603222) < 1e-5
    assert row.select(stats.rate(F.lit(1), F.lit(0)).alias("x")).first()["x"] == 0.0


def test_hashing_is_stable(spark):
    import hashlib

    want = int(hashlib.sha256("42:abc".encode()).hexdigest()[:16], 16)
    assert int(one(spark, H.stable_number(F.col("t")), t="abc")) == want
    assert one(spark, H.bucket(F.col("t")), t="abc") == want % 100


def test_category_cap_equals_greedy(spark):
    import hashlib

    rnd = random.Random(3)
    rows = [(i, rnd.choice("aaaabbc")) for i in range(120)]
    for target, cap in ((10, 2), (50, 20), (200, 200), (5, 1)):
        got = {r["i"] for r in sampling.category_cap(spark.createDataFrame(rows, "i int, c string"), "c", "i", target, cap).collect()}
        want, used = set(), {}
        for i, c in sorted(rows, key=lambda r: hashlib.sha256(f"42:{r[0]}".encode()).hexdigest()):
            if len(want) < target and used.get(c, 0) < cap:
                want.add(i)
                used[c] = used.get(c, 0) + 1
        assert got == want


def test_selection_is_feasible_and_largest(spark):
    rnd = random.Random(5)
    kinds = ["target_vs_model", "model_vs_model", "controlled_negative"]
    rows = [("train", f"p{i:03}", rnd.choice(kinds), f"s{i // 3}", rnd.choice("ab"), rnd.choice("AAB"), rnd.random(), rnd.randint(2, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "split string, pair_id string, pair_type string, source_id string, position string, tier string, confidence double, margin int")
    w = {"target_vs_model": 0.55, "model_vs_model": 0.35, "controlled_negative": 0.1}
    got = preference.select_pairs(df, 60, w).toPandas()
    quotas = preference.type_quotas(len(got), w)
    assert got["pair_type"].value_counts().to_dict() == quotas
    assert got["source_id"].value_counts().max() <= 2
    for k, q in quotas.items():
        assert k == "controlled_negative" or -(-q * 0.45 // 1) <= (got[got["pair_type"] == k]["position"] == "a").sum() <= q * 0.55 or q < 3
    natural = got[got["pair_type"] != "controlled_negative"]
    assert (natural["tier"] == "B").sum() <= int(len(natural) * 0.2)
    assert preference.select_pairs(df.where("false"), 60, w).count() == 0


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    with pytest.raises(ValueError, match="repeated"):
        joins.assert_unique(a.unionByName(a), "k")
    with pytest.raises(ValueError, match="no row"):
        joins.upsert(a, spark.createDataFrame([(3, "z")], "k int, v string"), "k")
    assert {tuple(r) for r in joins.upsert(a, spark.createDataFrame([(2, "z")], "k int, v string"), "k").collect()} == {(1, "x"), (2, "z")}


def test_chat(spark):
    row = spark.sql("select array(named_struct('from','gpt','value','o'), named_struct('from','human','value',' '), named_struct('from','human','value','a'), named_struct('from','gpt','value','b'), named_struct('from','human','value','c')) as t")
    q, a = chat.question_answer(F.col("t"))
    assert tuple(row.select(q, a).first()) == ("a", "b")
    h = row.select(chat.folded_history(F.col("t")).alias("h")).first()["h"]
    assert [tuple(x) for x in h] == [(" \na", "b")]
    assert chat.calls_in('<tool_call>{"name": "f", "arguments": {"x": 1}}</tool_call>', "tags") == [{"name": "f", "arguments": '{"x": 1}'}]
    assert chat.calls_in("<tool_call>{bad</tool_call>", "tags") is None
    assert chat.calls_in('Action: f\nAction Input: {"x": 1}', "action") == [{"name": "f", "arguments": '{"x": 1}'}]
    two = 'I will look.\nAction: f-1\nAction Input: ```json\n{"x": "Action"}\n```\nAction: g\nAction Input: "[2]"'
    assert chat.calls_in(two, "action") == [{"name": "f-1", "arguments": '{"x": "Action"}'}, {"name": "g", "arguments": "[2]"}]
    assert chat.calls_in("Action: f\nAction Input: none", "action") is None


def test_retrieval_ties_and_nulls(spark):
    rows = [(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(8)] + [(9, None), (None, [1.0, 1.0])]
    e = spark.createDataFrame(rows, "i int, v array<double>")
    got = retrieval.top_k(e, e.where("i = 1").withColumnRenamed("i", "q"), "i", "q", "v", 2).orderBy("rank").collect()
    assert [(r["i"], round(r["score"], 6)) for r in got] == [(3, 1.0), (5, 1.0)]
    assert retrieval.top_k(e.where("false"), e.withColumnRenamed("i", "q"), "i", "q", "v", 2).count() == 0


def test_masking(spark):
    c = spark.createDataFrame([("s", "胸痛三天，伴发热，否认外伤史，请问怎么办？", 1)], "source_id string, case_text string, loaded_at int")
    a = spark.sql("select 's' as source_id, 'train' as split, 'accepted' as validation_status, 1 as created_at, named_struct('evidence', array(named_struct('id','E1','span','胸痛三天','importance','critical','role','r','span_start',0,'span_end',4), named_struct('id','E2','span','伴发热','importance','supporting','role','r','span_start',null,'span_end',null))) as target")
    got = {r["mask_type"]: (r["removed"], r["case_text"]) for r in masking.mask_variants(a, c).collect()}
    assert got["critical"] == ("胸痛三天", "伴发热，否认外伤史，请问怎么办？")
    assert got["supporting"] == ("伴发热", "胸痛三天，否认外伤史，请问怎么办？")
    assert got["random"] == ("否认外伤史", "胸痛三天，伴发热，请问怎么办？")


def test_arrays(spark):
    x = spark.sql("select array('a','a','b') as p, array('a','c') as q, array() as z")
    assert x.select(A.multiset_overlap(F.col("p"), F.col("q")).alias("n")).first()["n"] == 1
    assert abs(x.select(A.overlap_f1(F.col("p"), F.col("q")).alias("n")).first()["n"] - 0.5) < 1e-9
    assert x.select(A.overlap_f1(F.col("z"), F.col("z")).alias("n")).first()["n"] == 0.0


def test_wrong_offsets_raise(spark):
    at = lambda span, a, b: F.array(F.struct(F.lit(span).alias("span"), F.lit(a).alias("span_start"), F.lit(b).alias("span_end")))
    assert one(spark, T.delete_named_spans(F.col("t"), at("发热", 3, 5)), t="咳嗽，发热，三天") == "咳嗽，三天"
    with pytest.raises(Exception, match="offset mismatch"):
        one(spark, T.delete_named_spans(F.col("t"), at("发热", 2, 4)), t="咳嗽，发热，三天")
    both = F.array(*[F.struct(F.lit(a).alias("span_start"), F.lit(b).alias("span_end")) for a, b in ((0, 3), (2, 4))])
    assert one(spark, T.delete_spans(F.col("t"), both), t="咳嗽，发热，三天") is None


def judged(decision, confidence, a, b, hard_a=(), hard_b=()):
    scores = lambda n: dict.fromkeys(preference.SCORES, 0) | {"medical_correctness": min(n, 3), "calibration": max(0, n - 3)}
    return (decision, (list(hard_a), list(hard_b)), (scores(a), scores(b)), ["calibration"], "reason", confidence)


J = "struct<decision:string,hard_failures:struct<a:array<string>,b:array<string>>,scores:struct<a:map<string,int>,b:map<string,int>>,decisive_dimensions:array<string>,reason:string,confidence:double>"


@pytest.mark.parametrize(
    ("first", "second", "tier", "reason"),
    [
        (judged("A_better", 0.9, 5, 2), judged("B_better", 0.9, 2, 5), "A", "strict_bidirectional_decision"),
        (judged("A_better", 0.1, 5, 2), judged("B_better", 0.9, 2, 5), None, "original:low_confidence"),
        (judged("A_better", 0.9, 5, 2, ["H1"]), judged("B_better", 0.9, 2, 5), None, "original:chosen_judge_hard_failure"),
        (judged("A_better", 0.95, 5, 2), judged("tie", 0.95, 2, 4), "B", "score_consistent_bidirectional"),
        (judged("A_better", 0.95, 5, 2), judged("A_better", 0.95, 5, 2), None, "tier_b:score_direction_inconsistent"),
        (judged("A_better", 0.95, 5, 2), judged("B_better", 0.5, 2, 5), None, "tier_b:low_confidence"),
        (judged("A_better", 0.95, 5, 2), judged("B_better", 0.95, 2, 5, [], ["H2"]), None, "tier_b:winner_hard_failure"),
        (judged("A_better", 0.95, 5, 2), judged("B_better", 2.0, 2, 5), None, "swap:invalid_judgment"),
        (judged("A_better", 0.95, 5, 2), None, None, "swap:missing"),
    ],
)
def test_reconcile(spark, first, second, tier, reason):
    row = lambda j: None if j is None else ("ok", "s", "train", "m", j)
    shape = f"struct<status:string,source_id:string,split:string,judge_model:string,j:{J}>"
    df = spark.createDataFrame([(row(first), row(second))], f"f {shape}, s {shape}")
    t, r = preference.reconcile(F.col("f"), F.col("s"))
    assert tuple(df.select(t, r).first()) == (tier, reason)


@pytest.mark.parametrize(
    ("case", "text", "high", "medium"),
    [
        ("服药5mg，共3天", "每日5g，3天后复查", [], []),
        ("血压150mmHg", "给药5mg，随访3天", ["5mg"], ["3天"]),
        ("白细胞12.5", "1. 复查；2、观察；白细胞12.5升高，再查12", [], ["12"]),
        ("体温38", "体温 39 ℃，心率90次/分", ["39", "90次"], []),
        (None, None, [], []),
    ],
)
def test_number_risk(spark, case, text, high, medium):
    df = spark.createDataFrame([(case, text)], "a string, b string")
    got = df.select(risk.number_risk(F.col("a"), F.col("b")).alias("r")).first()["r"]
    assert (got["high"], got["medium"]) == (high, medium)


@pytest.mark.parametrize(
    ("span", "role", "want"),
    [("咳嗽三天", "证实为肺炎", "high"), ("未见异常", "证实为肺炎", "medium"), ("咳嗽", "不能证实为肺炎", "clean"), ("咳嗽", "可排除其他", "clean"), ("咳嗽", "不能排除，但证实肺炎", "high"), ("诊断为肺炎", "确定诊断", "clean"), (None, "证实", "clean"), ("咳嗽", "说明症状", "clean")],
)
def test_role_risk(spark, span, role, want):
    df = spark.createDataFrame([(span, role)], "a string, b string")
    assert df.select(risk.role_risk(F.col("a"), F.col("b")).alias("r")).first()["r"] == want


TARGET = "struct<task_type:string,query_intent:array<string>,evidence_sufficiency:string,evidence:array<struct<id:string,span:string,importance:string,role:string,span_start:int,span_end:int>>,critical_evidence_ids:array<string>,missing_information:array<string>,clinical_reasoning:string,final_answer:string>"
CASE = "患者咳嗽三天，伴发热39℃，胸片提示右下肺炎症，请问怎么治疗？"


def target(**changed):
    ev = [("E1", "咳嗽三天", "critical", "提示呼吸道感染", None, None), ("E2", "胸片提示右下肺炎症", "supporting", "影像学支持", None, None)]
    base = {"task_type": "confirmed_management", "query_intent": ["询问治疗"], "evidence_sufficiency": "partial", "evidence": ev, "critical_evidence_ids": ["E1"], "missing_information": ["血常规"], "clinical_reasoning": "患者咳嗽并有影像改变，考虑下呼吸道感染可能性大。", "final_answer": "建议完善血常规后由医生决定抗感染治疗方案，注意休息，多饮水，观察体温变化情况。"}
    return tuple((base | changed).values())


@pytest.mark.parametrize(
    ("changed", "errors", "review"),
    [
        ({}, [], []),
        ({"evidence": [("E1", "胸痛", "critical", "提示呼吸道感染", None, None)]}, ["evidence_span_not_in_case"], []),
        ({"critical_evidence_ids": ["E2"]}, ["critical_importance_mismatch"], []),
        ({"evidence_sufficiency": "sufficient", "evidence": [], "critical_evidence_ids": []}, ["sufficient_without_evidence"], []),
        ({"missing_information": []}, [], ["partial_without_missing_information"]),
        ({"query_intent": ["a", " "]}, ["query_intent_contains_invalid_item"], []),
        ({"query_intent": []}, ["query_intent_empty"], []),
        ({"evidence": [("E1", "咳嗽三天", "critical", "提示呼吸道感染", None, None), ("x", "嗽三天", "supporting", "影像学支持", None, None)]}, [], ["noncanonical_evidence_id", "nonsequential_evidence_ids", "overlapping_evidence_spans"]),
    ],
)
def test_target_issues(spark, changed, errors, review):
    df = spark.createDataFrame([(CASE, target(**changed))], f"c string, t {TARGET}")
    e, r, _ = audit.target_issues(F.col("c"), F.col("t"))
    assert tuple(df.select(e, r).first()) == (errors, review)


def test_target_warnings(spark):
    ev = [("E1", "咳嗽三天", "critical", "可以证实感染存在", None, None)]
    df = spark.createDataFrame([(CASE, target(evidence=ev, final_answer="建议服药250mg，每日3次，共7天，体温39℃时退热，并在完成后复查胸片与血常规指标。"))], f"c string, t {TARGET}")
    w = audit.target_issues(F.col("c"), F.col("t"))[2]
    assert df.select(w.alias("w")).first()["w"] == ["generated_numbers_require_review:250mg,3次,7天", "strong_role_claim_requires_review"]


def test_judgment_validators(spark):
    s = dict.fromkeys(evaluation.CLINICAL_DIMENSIONS, 3)
    shape = "d string, s struct<a:map<string,int>,b:map<string,int>>, e struct<a:boolean,b:boolean>, r string"
    rows = [("tie", (s, s), (True, False), "x"), ("other", (s, s), (True, False), "x"), ("tie", (s, s | {"fluency": 6}), (True, False), "x"), ("tie", (s, {}), (True, False), "x"), ("tie", (s, s), (None, False), "x"), ("tie", (s, s), (True, False), " "), (None, None, None, None)]
    ok = evaluation.valid_clinical_judgment(F.col("d"), F.col("s"), F.col("e"), F.col("r"))
    assert [r[0] for r in spark.createDataFrame(rows, shape).select(ok).collect()] == [True] + [False] * 6
    m = "j struct<decision:string,expected_certainty_change:string,removed_fact_concepts:array<string>,required_missing_concepts:array<string>,forbidden_specific_claims:array<string>,reasons:array<string>,allowed_conclusion_scope:string>"
    rows = [(("accept", "stay", [], ["a"], [], ["r"], "scope"),), (("accept", "up", [], [], [], [], "scope"),), (("accept", "stay", [" "], [], [], [], "scope"),), (("accept", "stay", None, [], [], [], "scope"),), (("accept", "stay", [], [], [], [], ""),), (None,)]
    assert [r[0] for r in spark.createDataFrame(rows, m).select(evaluation.valid_mask_judgment(F.col("j"))).collect()] == [True] + [False] * 5
    n = "j struct<appropriate_response:boolean,removed_fact_leakage:boolean,conclusion_scope_appropriate:boolean,missing_information_appropriate:boolean,safe_answer:boolean,main_conclusion_behavior:string,reasons:array<string>>"
    rows = [((True, False, True, True, True, "stay", ["r"]),), ((None, False, True, True, True, "stay", []),), ((True, False, True, True, True, "up", []),), ((True, False, True, True, True, "stay", [""]),)]
    assert [r[0] for r in spark.createDataFrame(rows, n).select(evaluation.valid_response_judgment(F.col("j"))).collect()] == [True, False, False, False]


def test_paired_variants_and_expected_change(spark):
    v = spark.createDataFrame([("p", "critical", "p::C"), ("p", "supporting", "p::S"), ("p", "random", "p::R"), ("q", "critical", "q::C")], "parent string, mask_type string, variant_id string")
    assert {r["variant_id"] for r in evaluation.paired_variants(v, 1).collect()} == {"p::U", "p::C", "p::S", "p::R"}
    with pytest.raises(ValueError, match="fewer than 2"):
        evaluation.paired_variants(v, 2)
    rows = [("downgrade", "partial", "insufficient", True), ("downgrade", "partial", "partial", False), ("stay", "partial", "partial", True), ("stay", "conflicting", "partial", None), (None, "partial", "partial", None)]
    got = spark.createDataFrame(rows, "e string, u string, m string, w boolean").select(evaluation.expected_change(F.col("e"), F.col("u"), F.col("m")), "w").collect()
    assert all(a == w for a, w in got)


def test_pairs_of_one_source(spark):
    """The worst answer meets the target, the best meets the worst, copies and unsound answers take no part."""
    src = spark.createDataFrame([("s", "train", CASE, target())], f"source_id string, split string, case_text string, target {TARGET}")
    base = target()
    good = (["血常规"], base[6], base[7] + "请按时复诊。")
    more = (["血常规", "既往史"], base[6], base[7] + "如有不适随时就医。")
    rows = [("s", "m0", 0, good), ("s", "m1", 1, more), ("s", "m2", 2, good), ("s", "m3", 3, (base[5], base[6], base[7])), ("s", "m4", 4, (["x"], base[6], "太短")), ("s", "m5", 5, ([" "], base[6], base[7])), ("s", "m6", 6, None)]
    c = spark.createDataFrame(rows, "source_id string, candidate_id string, no int, answer struct<missing_information:array<string>,clinical_reasoning:string,final_answer:string>")
    got = {r["pair_type"]: ({r["candidate_a"], r["candidate_b"]}, r["difference_fields"]) for r in pairs.build_pairs(src, c).collect()}
    assert got["target_vs_model"][0] == {"validated_target", "m1"} and got["model_vs_model"][0] == {"m0", "m1"}
    assert got["target_vs_model"][1] == ["missing_information", "final_answer"] and "validated_target" in got["controlled_negative"][0]


def test_prompts_equal_json_dumps(spark):
    import json

    src = spark.createDataFrame([(CASE, target(), target(missing_information=[], final_answer='含"引号"\n换行')), (None, target(evidence=None), target())], f"case_text string, response_a {TARGET}, response_b {TARGET}")
    for row, r in zip(prompts.pair_prompts(src, "case_text", "response_a", "response_b").collect(), src.collect(), strict=True):
        a, b = r["response_a"].asDict(True), r["response_b"].asDict(True)
        shared = {f: a[f] if f != "evidence" or a[f] is None else [{k: e[k] for k in ("id", "span", "importance", "role")} for e in a[f]] for f in prompts.FROZEN_FIELDS}
        view = lambda t: {f: t[f] for f in preference.ANSWER_FIELDS}
        want = json.dumps({"case_text": r["case_text"], "shared_structure": shared, "answer_A": view(a), "answer_B": view(b)}, ensure_ascii=False, indent=2)
        assert row["prompt"] == prompts.OPENINGS["pair_judge"] + want
    x = src.withColumn("k", F.lit("id"))
    one_way, other = (prompts.answer_prompts(x, "k", "response_a", "response_b", "case_text", swapped=w).first()["prompt"] for w in (False, True))
    assert one_way != other and sorted(one_way) == sorted(other)


def test_rendering_and_tokens(spark):
    row = spark.sql("select array(named_struct('user','q1','assistant','a1'), named_struct('user','q2','assistant',cast(null as string))) as h, array(5,6,2,0,0) as t, array(5,0,6,0,0) as u")
    got = row.select(
        chat.rendered(F.col("h"), F.lit("sys"), "U: {query} A: ").alias("a"), chat.rendered(F.col("h"), F.lit("")).alias("b"), records.trimmed_tokens(F.col("t"), 2, 0).alias("c"), records.trimmed_tokens(F.col("u"), 2, 0).alias("d"),
        records.budgets(F.lit(300), F.lit(100), 200).alias("e"), records.budgets(F.lit(30), F.lit(10), 200).alias("f"),
    ).first()
    assert got["a"] == "sys\nU: q1 A: a1\nU: q2 A: " and got["b"] == "q1a1\nq2"
    assert got["c"] == [5, 6] and got["d"] == [5, 0, 6]
    assert tuple(got["e"]) == (150, 50) and tuple(got["f"]) == (30, 10)


@pytest.mark.parametrize(
    ("raw", "want"),
    [('{"conversations": [{"from": "human", "value": "a"}]}', "valid"), ("{bad", "not_json"), ('{"x": 1}', "no_conversations"), ('{"conversations": []}', "no_conversations"), ('{"conversations": [{"from": "human"}]}', "missing_fields"), ('{"conversations": [{"from": "bot", "value": "a"}]}', "unknown_role")],
)
def test_conversation_issue(spark, raw, want):
    assert one(spark, chat.conversation_issue(F.col("t")), t=raw) == want


def test_alpaca(spark):
    row = spark.createDataFrame([("do", "this", "done"), ("do", " ", "done"), ("do", None, "done")], "i string, t string, o string")
    got = row.select(chat.alpaca(F.col("i"), F.col("t"), F.col("o")).alias("c")).collect()
    assert [(r["c"][0]["value"], r["c"][1]["value"]) for r in got] == [("do\n\nthis", "done"), ("do", "done"), ("do", "done")]


def test_structure_and_signature(spark):
    ev = target()[3]
    rows = [(target(), target(final_answer="另一个回答")), (target(), target(evidence=ev[::-1])), (target(), target(evidence_sufficiency="sufficient")), (target(), target(evidence=ev[:1]))]
    df = spark.createDataFrame(rows, f"a {TARGET}, b {TARGET}")
    assert [r[0] for r in df.select(records.same_structure(F.col("a"), F.col("b"))).collect()] == [True, True, False, False]
    sig = [tuple(r) for r in df.select(records.answer_signature(F.col("a")), records.answer_signature(F.col("b"))).collect()]
    assert sig[0][0] != sig[0][1] and sig[1][0] == sig[1][1] and sig[0][0].startswith('{"clinical_reasoning":')
