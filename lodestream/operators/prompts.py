"""Prompts for teachers and judges: a fixed line and a payload as indented JSON, built as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from lodestream.functions.hashing import first_position
from lodestream.operators.preference import ANSWER_FIELDS

# The line that opens each kind of prompt, and the fields that both answers of a pair share.
OPENINGS = {
    "teacher": "请根据下列输入生成证据约束样本。task_type_hint 只是启发，如判断有误可以纠正。\n",
    "mask_teacher": "请根据当前可见病例生成证据约束 JSON。task_type_hint 仅供参考，可以纠正。\n",
    "pair_judge": "请按 rubric 比较两个回答：\n",
    "answer_judge": "请比较两个回答：\n",
    "clinical_judge": "请盲评以下两个回答：\n",
    "mask_judge": "请审核以下反事实样本：\n",
    "response_judge": "请盲评以下 Mask 响应：\n",
}
FROZEN_FIELDS = ("task_type", "query_intent", "evidence_sufficiency", "evidence", "critical_evidence_ids")


def _scalar(col: Column) -> Column:
    """A scalar as JSON, null as null."""
    whole = F.to_json(F.struct(col.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(whole, F.lit(6), F.length(whole) - 6)  # without {"v": and }


def indented(col: Column, kind: DataType, level: int = 0) -> Column:
    """A value of the given type as JSON with an indent of two, its fields in their order; empty lists and objects stay on one line."""
    inner, outer = "\n" + "  " * (level + 1), "\n" + "  " * level
    if isinstance(kind, StructType):
        parts = [F.concat(F.lit(f'"{f.name}": '), indented(col[f.name], f.dataType, level + 1)) for f in kind.fields]
        body = F.concat(F.lit("{" + inner), F.concat_ws("," + inner, *parts), F.lit(outer + "}"))
    elif isinstance(kind, ArrayType):
        items = F.array_join(F.transform(col, lambda x: indented(x, kind.elementType, level + 1)), "," + inner)
        body = F.when(F.size(col) == 0, "[]").otherwise(F.concat(F.lit("[" + inner), items, F.lit(outer + "]")))
    elif isinstance(kind, MapType):
        items = F.array_join(F.transform(F.map_entries(col), lambda e: F.concat(_scalar(e["key"].cast("string")), F.lit(": "), indented(e["value"], kind.valueType, level + 1))), "," + inner)
        body = F.when(F.size(col) == 0, "{}").otherwise(F.concat(F.lit("{" + inner), items, F.lit(outer + "}")))
    else:
        return _scalar(col)
    return F.when(col.isNull(), "null").otherwise(body)


def prompts(df: DataFrame, kind: str, payload: dict[str, Column], *keep: str) -> DataFrame:
    """``keep`` columns and ``prompt``: the opening of ``kind`` and the named payload columns. Null parts of a payload are null in it."""
    x = df.select(*keep, F.struct(*[c.alias(n) for n, c in payload.items()]).alias("_payload"))
    text = F.concat(F.lit(OPENINGS[kind]), indented(F.col("_payload"), x.schema["_payload"].dataType))
    return x.select(*keep, text.cast(StringType()).alias("prompt"))


def shared_structure(target: Column) -> Column:
    """The fields of a target that both answers of a pair share, evidence without offsets."""
    ev = F.transform(target["evidence"], lambda e: F.struct(*[e[f].alias(f) for f in ("id", "span", "importance", "role")]))
    return F.struct(*[(ev if f == "evidence" else target[f]).alias(f) for f in FROZEN_FIELDS])


def answer_view(target: Column) -> Column:
    """The answer fields of a target."""
    return F.struct(*[target[f].alias(f) for f in ANSWER_FIELDS])


def teacher_prompts(candidate: DataFrame, *keep: str) -> DataFrame:
    """Prompts that ask a teacher for a target of each candidate."""
    return prompts(candidate, "teacher", {c: F.col(c) for c in ("task_type_hint", "case_text", "original_answer")}, *keep)


def pair_prompts(pairs: DataFrame, *keep: str) -> DataFrame:
    """Prompts that ask a judge to compare the answers of built pairs with their case."""
    p = {"case_text": F.col("case_text"), "shared_structure": shared_structure(F.col("response_a")), "answer_A": answer_view(F.col("response_a")), "answer_B": answer_view(F.col("response_b"))}
    return prompts(pairs, "pair_judge", p, *keep)


def answer_prompts(rows: DataFrame, key: str, baseline: str, candidate: str, case: str, swapped: bool = False, seed: int = 42) -> DataFrame:
    """``key, prompt``: prompts that compare the answers of two systems, in a blind order by hash of the key, or with the sides ``swapped``.

    Rows in which a target or an answer field is null are left out.
    """
    whole = F.lit(True)
    for side in (baseline, candidate):
        for f in ANSWER_FIELDS:
            whole = whole & F.col(f"{side}.{f}").isNotNull()
    base_first = first_position(F.col(key), F.lit("eval_position"), seed=seed)
    if swapped:
        base_first = ~base_first
    a, b = answer_view(F.col(baseline)), answer_view(F.col(candidate))
    x = rows.where(whole)
    return prompts(x, "answer_judge", {"case_text": F.col(case), "answer_A": F.when(base_first, a).otherwise(b), "answer_B": F.when(base_first, b).otherwise(a)}, key)
