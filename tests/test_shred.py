import json

from lodestream.operators.shred import analyse, candidate_tables, named_evidence, parse_json, shred

SCHEMA = "raw_id bigint, source_id string, payload string, doc_key string, fields string"


def frame(spark, payloads):
    rows = [(i, None, p if p is None or isinstance(p, str) else json.dumps(p), "x", "y") for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, SCHEMA)


def record(cands):
    return {"source_id": "s", "candidates": cands}


def cand(cid, ev, crit):
    return {"candidate_id": cid, "audit": {"parsed_output": {"evidence": ev, "critical_evidence_ids": crit}}}


def test_shapes(spark):
    ev = [{"id": "E1", "span": "a", "review": {"flags": [{"code": "x", "id": "E9"}]}}, {"id": " e2 ", "span": "b"}, None]
    payloads = [
        record([cand("c0", ev, ["e1 ", "E9"])]),
        record([cand("c0", json.dumps(ev), "E2,E1 ")]),
        record(cand("c0", {"items": ev, "count": 3}, [{"id": "E2", "weight": 0.1}])),
        record([cand("c0", {"id": "E1", "span": "a"}, "E1"), cand("c1", ev, None), None, 3]),
        record([{"candidate_id": "c0", "audit": {"parsed_output": {"result": {"evidence": ev, "critical_evidence_ids": ["E2"]}, "meta": {"n": 1}}}}]),
        "{broken", "", "[]", "null", None, "3", '{"candidates": NaN}', json.dumps(record([cand("c0", ev, ["E1"])])) + " x",
    ]
    df = frame(spark, payloads)
    got = {tuple(r) for r in named_evidence(df.unionByName(df)).collect()}
    assert got == {(0, "c0", "E1"), (1, "c0", "E1"), (1, "c0", "E2"), (2, "c0", "E2"), (3, "c0", "E1"), (4, "c0", "E2")}


def test_rows_name_their_parents(spark):
    df = frame(spark, [record([cand("a", [{"id": "E1"}], []), cand("a", [{"id": "E1"}, {"id": "E2"}], ["E1"])])])
    t = {k: v.collect() for k, v in candidate_tables(df).items()}
    nodes = {r["candidate_node"]: r["candidate_no"] for r in t["candidates"]}
    assert sorted(nodes.values()) == [0, 1]
    assert {(nodes[r["candidate_node"]], r["evidence_id"]) for r in t["evidence"]} == {(0, "E1"), (1, "E1"), (1, "E2")}
    assert {r["record_node"] for r in t["candidates"]} == {r["record_node"] for r in t["records"]}


def test_recursion_and_long_text(spark):
    deep = {"name": "a", "children": [{"name": "b", "children": [{"name": "c" * 200_000, "children": []}]}]}
    df = frame(spark, [deep])
    plan = analyse(df, "payload")
    assert plan.tables == {"children"}
    rows = shred(df, "raw_id", "payload", plan).collect()
    assert sorted(len(r["fields"]["name"]) for r in rows) == [1, 1, 200_000]
    assert sum(r["parent_table"] == "children" for r in rows) == 1


def test_empty_table(spark):
    df = frame(spark, [])
    assert named_evidence(df).count() == 0


def test_json_grammar():
    assert parse_json('{"a": 1, "a": 2}') == (True, {"a": 2})
    assert not parse_json("{'a': 1}")[0] and not parse_json("Infinity")[0] and not parse_json("[" * 100_000)[0]


def test_large_keys_beside_null_keys(spark):
    body = json.dumps(record([cand("a", [{"id": "E1"}], ["E1"])]))
    df = spark.createDataFrame([(2**60 + 1, None, body, "", ""), (None, None, body, "", "")], SCHEMA)
    assert {r["raw_id"] for r in named_evidence(df).collect()} == {2**60 + 1, None}
