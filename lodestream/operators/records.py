"""Record converters: projections between conversation, preference and training shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestream.functions.arrays import alignment_signature, without_offsets
from lodestream.functions.jsonx import compact
from lodestream.operators.chat import two_turns

ANSWER_FIELDS = ("missing_information", "clinical_reasoning", "final_answer")
#: Field pairs by which a record names its question and its answer, in order of precedence.
QUESTION_ANSWER = (("question", "answer"), ("instruction", "output"), ("prompt", "response"), ("input", "target"))


def preference_record(df: DataFrame, question: str = "question", chosen: str = "response_chosen", rejected: str = "response_rejected") -> DataFrame:
    """``prompt, chosen, rejected`` from a reward record; an error names missing columns. Rows with a null part are left out."""
    missing = [c for c in (question, chosen, rejected) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(F.col(question).alias("prompt"), F.col(chosen).alias("chosen"), F.col(rejected).alias("rejected")).dropna()


def labelled(text: Column, *labels: Column) -> Column:
    """The first non-blank label, a full-width colon and the text; the text alone without a label."""
    label = F.coalesce(*[F.when(F.trim(x) != "", x) for x in labels])
    return F.when(label.isNotNull(), F.concat(label, F.lit("："), text)).otherwise(text)


def to_conversation(df: DataFrame, labels: tuple[str, ...] = ("label", "category", "domain")) -> DataFrame:
    """``conversations`` and the columns it was not built from: the first pair of QUESTION_ANSWER that both are non-null."""
    pairs = [p for p in QUESTION_ANSWER if set(p) <= set(df.columns)]
    if not pairs:
        raise ValueError("no question and answer columns")
    whole = [F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs]
    q = F.coalesce(*[F.when(ok, F.col(a)) for ok, (a, _) in zip(whole, pairs, strict=True)])
    a = F.coalesce(*[F.when(ok, F.col(b)) for ok, (_, b) in zip(whole, pairs, strict=True)])
    named = [F.col(c) for c in labels if c in df.columns]
    used = {c for p in pairs for c in p} | {"label"}
    rest = [c for c in df.columns if c not in used]
    return df.select(two_turns(labelled(q, *named) if named else q, a).alias("conversations"), *rest).where(F.exists("conversations", lambda t: t["value"].isNotNull()))


def training_rows(audited: DataFrame, candidate: DataFrame, instruction: str) -> DataFrame:
    """``source_id, split, task_type, conversations``: instruction and case against the target as JSON without offsets.

    Of several targets of a source_id the earliest counts, then the least as text; null source_ids and targets give none.
    """
    case = candidate.where("case_text is not null").groupBy("source_id").agg(F.max("case_text").alias("case_text"))
    target = F.col("target").withField("evidence", without_offsets(F.col("target.evidence")))
    row = F.struct("created_at", compact(target).alias("answer"), "split", F.col("target.task_type").alias("task_type"))
    x = audited.where("target is not null and source_id is not null").groupBy("source_id").agg(F.min(row).alias("t")).join(case, "source_id")
    return x.select("source_id", "t.split", "t.task_type", two_turns(F.concat(F.lit(instruction), F.col("case_text")), F.col("t.answer")).alias("conversations"))


def overlay_answer(target: Column, answer: Column) -> Column:
    """The target with the three answer fields of ``answer``; null where one of these is null."""
    whole = answer["missing_information"].isNotNull() & answer["clinical_reasoning"].isNotNull() & answer["final_answer"].isNotNull()
    out = target
    for f in ANSWER_FIELDS:
        out = out.withField(f, answer[f])
    return F.when(whole, out)


def same_structure(a: Column, b: Column) -> Column:
    """Whether two targets agree in all but their answer fields: type, sufficiency and evidence, in any order."""
    return a["task_type"].eqNullSafe(b["task_type"]) & a["evidence_sufficiency"].eqNullSafe(b["evidence_sufficiency"]) & alignment_signature(a["evidence"]).eqNullSafe(alignment_signature(b["evidence"]))


def answer_signature(target: Column) -> Column:
    """The answer fields as one JSON text, fields in alphabetical order."""
    return compact(F.struct(*[target[f].alias(f) for f in sorted(ANSWER_FIELDS)]))


def trimmed_tokens(tokens: Column, end: int, pad: int) -> Column:
    """Tokens before the first end mark; without one, trailing pads are dropped."""
    at = F.array_position(tokens, F.lit(end))
    kept = F.filter(F.transform(tokens, lambda x, i: F.when(x != pad, i)), lambda i: i.isNotNull())
    return F.when(at > 0, F.slice(tokens, F.lit(1), at - 1)).otherwise(F.slice(tokens, F.lit(1), F.coalesce(F.array_max(kept) + 1, F.lit(0))))


def budgets(prompt: Column, answer: Column, most: int) -> Column:
    """Struct (prompt, answer): lengths cut in proportion to the whole where it exceeds ``most``, the prompt first."""
    whole = prompt + answer
    source = F.when(whole > most, F.floor(most * prompt / whole)).otherwise(prompt)
    return F.struct(source.cast("int").alias("prompt"), F.least(answer, F.lit(most) - source).cast("int").alias("answer"))
