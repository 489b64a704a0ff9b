"""Broken prompt and response pairs by noisy labelling functions and an expectation-maximization label model."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.llm.textkeys import canonical, pieces
from lodestream.llm.truncation import is_empty, tail_state, truncated_values
from lodestream.session import materialize

#: In order of precedence, for fields that may have one defect only.
DEFECTS = ("empty", "language", "copy", "refusal", "truncated")

# Ways to decline.
_DECLINE_ZH = re.compile(
    "恕[不难]|不予(?:作答|回答|回复|解答)|不便(?:讨论|回答|作答|透露|评论)|不参与讨论|给不出|(?:无法|不能|难以|无权)[^。，]{0,12}(?:提供|回答|作答|回复|解答|协助|给出|讨论)"
    "|拒绝(?:回答|给出|提供|这个|该|此|讨论)|作为[^。，]{0,6}(?:语言模型|人工智能|AI)|不具备[^。，]{0,6}资格|(?:超出|不在)[^。，]{0,8}(?:能力|范围|权限)"
    "|帮不上|没有?办法[^。，]{0,6}(?:回答|回复|帮助|提供|判断|处理)|(?:没有|未|不)被?(?:授权|允许)[^。，]{0,8}(?:回答|回复|讨论|提供|评论)|另寻(?:渠道|途径|高明)|爱莫能助|无可奉告|不可以[^。，]{0,6}(?:回答|讨论|提供)"
)
_DECLINE_EN = re.compile(
    r"\b(?:can(?:'|’)?t|cannot|can not|unable to|not able to|won(?:'|’)?t|decline to|refuse to|not (?:allowed|permitted|qualified) to)\s+(?:\w+\s+){0,2}(?:help|assist|give|provide|answer|comment|discuss|respond|advise)"
    r"|\bas an? (?:ai|language model|assistant)\b|\bi (?:must|have to) (?:decline|refuse)\b|\b(?:falls?|is|lies|goes) (?:outside|beyond) (?:what|my|our|the scope)\b|\bagainst (?:my|our|the) (?:policy|policies|rules|guidelines)\b|\bnot (?:allowed|permitted|authori[sz]ed|able|free) to\b",
    re.I,
)
# Characters with which a way to decline begins, and words one of which every English way has: what is looked for first.
_DECLINE_START = re.compile("[恕不给无难拒作超在帮没未另爱]")
_DECLINE_HINTS = ("can", "unable", "not ", "won", "decline", "refuse", "as a", "outside", "beyond", "against")
_SORRY = "抱歉 对不起 不好意思 请原谅 遗憾 谅解 恕 sorry apolog regret decline unable".split()
# Words that carry advice in an answer.
_ADVICE = "复查 服用 检查 观察 加重 治疗 考虑 提示 支持 符合 面诊 饮食 规范 标准 剂量 tablet dose repeat avoid test scan clinic emergency".split()
# Frequent function words of languages written in Latin letters.
_WORDS = {
    "en": "the of and to is are was with for that this in on it be not you your if at or has have been from should may".split(),
    "de": "der die das und ist nicht sie ein eine mit für auf den dem des von zu sich bitte noch lassen bei wird".split(),
    "fr": "le la les des une est et vous pour dans ces que ne pas au du sur par votre avec un".split(),
    "es": "el los las una es y para que con por su del al se no más esta como lo si".split(),
    "it": "il gli una è e per che con non si della dei questo sono come di".split(),
    "pt": "o os as uma é e para que com não se da dos em seu por".split(),
}
_VOTE = {w: k for k, ws in reversed(_WORDS.items()) for w in ws}




_FOREIGN = re.compile("[぀-ヿ가-힯Ѐ-ӿ؀-ۿ]")
_OTHER = {k: re.compile(f"[^{v}]+") for k, v in (("han", "一-鿿"), ("kana", "぀-ヿ"), ("hangul", "가-힯"), ("cyrillic", "Ѐ-ӿ"), ("arabic", "؀-ۿ"))}
_LETTERS = re.compile(r"[^\W\d_぀-ヿ一-鿿가-힯Ѐ-ӿ؀-ۿ]+")
_NO_LETTER = re.compile(r"[\W_]+")


def language(text: str) -> str | None:
    """zh, ja, ko, ru, ar, or a language in Latin letters; null if there is too little to tell."""
    s = text if text.isascii() else unicodedata.normalize("NFKC", text)
    words = _LETTERS.findall(s.lower())
    if not s.isascii():
        far = _FOREIGN.search(s) is not None
        n = {k: len(r.sub("", s)) if far or k == "han" else 0 for k, r in _OTHER.items()}
        if n["kana"] >= 4 and n["kana"] * 4 >= n["han"]:
            return "ja"
        if n["hangul"] >= 4:
            return "ko"
        if n["cyrillic"] > 2 * len(words) and n["cyrillic"] >= 6:
            return "ru"
        if n["arabic"] >= 6:
            return "ar"
        if n["han"] >= 2 and n["han"] >= len(words):
            return "zh"
    if len(words) < 3:
        return None
    score: dict[str, int] = {}
    for w in words:
        if w in _VOTE:
            score[_VOTE[w]] = score.get(_VOTE[w], 0) + 1
    return max(score, key=lambda k: (score[k], k == "en")) if score else "latin"


@lru_cache(maxsize=1024)
def _case(case: str | None) -> tuple[set[str], str | None]:
    """Pieces and language of a case; the fields of one record follow each other."""
    return pieces(canonical(case), 5), language(case) if case else None


def _declines(text: str, low: str) -> bool:
    if any(_DECLINE_ZH.match(text, m.start()) for m in _DECLINE_START.finditer(text)):
        return True
    return any(w in low for w in _DECLINE_HINTS) and _DECLINE_EN.search(text) is not None


def _votes(text: str | None, case: str | None, cut: bool) -> tuple[tuple[int, int, int], ...]:
    """Votes of the three labelling functions of each of DEFECTS: 1 for, 0 against, -1 abstains."""
    blank = not (text or "").strip(" \t\r\n　​‌‍﻿")
    none = (-1, -1, -1)
    if is_empty(text):
        return (1, 1 if blank else -1, 1), none, none, none, none
    assert text is not None
    letters, low = len(_NO_LETTER.sub("", text)), text.lower()
    empty = (0, 0, -1 if letters < 12 else 0)
    state = tail_state(text)[0]
    truncated = (int(cut), 1 if state == "broken" else -1, int(state != "closed"))
    declines = _declines(text, low)
    advice = sum(map(low.count, _ADVICE))
    short = letters < 90 and not advice
    sorry = short and (declines or any(w in low for w in _SORRY))
    refusal = (int(declines), (1 if sorry else -1) if short else 0 if advice > 1 else -1, 0 if letters > 160 else -1)
    h, lb = _case(case)
    g = pieces(canonical(text), 5)
    copy = language_votes = none
    if len(g) >= 4 and h:
        both = len(g & h)
        inside, covered = both / len(g), both / len(h)
        copy = (int(inside >= 0.75), int(covered >= 0.4) if inside >= 0.5 else 0, 1 if inside >= 0.9 and covered >= 0.3 else 0 if inside < 0.6 else -1)
    la = language(text)
    if la and lb:
        far = {la, lb} & {"zh", "ja", "ko", "ru", "ar"}
        language_votes = (int(la != lb), (int(la != lb) if far or (la == "en") == (lb == "en") else 1 if la != "latin" else -1), 0 if la == lb else -1)
    return empty, language_votes, copy, refusal, truncated


def label_model(votes: np.ndarray, count: np.ndarray, steps: int = 60, prior: float = 0.02) -> np.ndarray:
    """Posterior of the positive class for each vote pattern (rows of 1, 0, -1), by expectation-maximization.

    Each function has its own rate of voting 1 under either class; abstentions say nothing. Rates start at 0.95 and
    0.02 and are smoothed by two pseudo-counts of that start, so a function that never errs cannot outvote the prior.
    """
    on, off = votes == 1, votes == 0
    hit, false, p = np.full(votes.shape[1], 0.95), np.full(votes.shape[1], 0.02), prior
    post = np.zeros(len(votes))
    for _ in range(steps):
        pos = np.log(p) + on @ np.log(hit) + off @ np.log(1 - hit)
        neg = np.log(1 - p) + on @ np.log(false) + off @ np.log(1 - false)
        post = 1 / (1 + np.exp(np.clip(neg - pos, -700, 700)))
        w, v = post * count, (1 - post) * count
        hit = np.clip((w @ on + 1.9) / (w @ (on | off) + 2), 0.02, 0.999)
        false = np.clip((v @ on + 0.04) / (v @ (on | off) + 2), 1e-4, 0.9)
        p = float(np.clip((w.sum() + prior) / (count.sum() + 1), 1e-5, 0.6))
    return post


def _code(votes: tuple[int, int, int]) -> int:
    """The votes as a number from 0 to 26."""
    return votes[0] + 1 + 3 * (votes[1] + 1) + 9 * (votes[2] + 1)


#: What F1 may lose on validation rows that are not sound.
NOISE = 0.02
_PATTERNS = np.array([[c % 3 - 1, c // 3 % 3 - 1, c // 9 - 1] for c in range(27)])
# Refusals and texts in other languages that are planted to validate the cutoffs.
_PLANTED_REFUSAL = ("对不起，这个问题我无法给出回答。", "抱歉，不便评论您的情况，请另寻途径。", "I am sorry, but I cannot help with this request.", "As an AI, I am not able to provide an answer.")
_PLANTED_LANGUAGE = {
    True: ("The findings point to a mild course and the patient should return for a check in two weeks.", "Die Beschwerden sind nicht gefährlich und es ist mit einer Besserung zu rechnen."),
    False: ("目前的表现提示病情较轻，建议两周后复查，并注意休息和饮食。", "現在の症状は軽いため、二週間後に再検査を受けてください。"),
}


def planted(rows: list[tuple[str | None, str | None, str | None]]) -> list[tuple[int, str, str | None, str | None, str]]:
    """(number, field, text, case_text, defect or none) of records (field, text, case_text), each as it is and with one defect of each kind."""
    out = []
    for field, text, case in rows:
        if not text or is_empty(text):
            continue
        n = len(out)
        han = language(case or text) == "zh"
        cuts = [p for p in range(len(text) * 2 // 5, len(text) * 9 // 10) if text[p - 1].isalnum() and text[p].isalnum()]
        made = [("", text), ("empty", ("", None, "　", "暂无", "N/A", "无")[n % 6]), ("refusal", _PLANTED_REFUSAL[n % 2 if han else 2 + n % 2]), ("language", _PLANTED_LANGUAGE[han][n % 2])]
        made += [("truncated", text[: cuts[n % len(cuts)]])] if cuts else []
        made += [("copy", ("", "病例如下：", case + "\n")[n % 3] + case)] if case and len(case) >= 20 else []
        out += [(n + i, field, t, case, d) for i, (d, t) in enumerate(made)]
    return out


def best_cutoff(post: np.ndarray, true: np.ndarray) -> float:
    """The posterior beyond which F1 on the validation rows is highest; of those within NOISE of it the one nearest to 0.5.

    Fields taken as they are count as sound, though some have a defect of their own; hence NOISE.
    """
    value = np.unique(np.r_[0.0, post, 1.0])
    cuts = (value[1:] + value[:-1]) / 2
    f1 = [2 * (true & (post > c)).sum() / max(1, true.sum() + (post > c).sum()) for c in cuts]
    good = cuts[np.array(f1) >= max(f1) - NOISE]
    return 0.5 if good.min() <= 0.5 <= good.max() else float(good[np.argmin(np.abs(good - 0.5))])


def response_defects(audited: DataFrame, candidate: DataFrame, cutoff: float | None = None, probes: int = 300) -> DataFrame:
    """``source_id, field, defect, posterior`` of every response field and defect whose posterior exceeds its cutoff.

    Without a ``cutoff`` for all, that of each defect is validated: at most ``probes`` fields (the first by hash) are planted with each
    defect, pass through all labelling functions, are no evidence for others, and the cutoff with the best F1 on them holds
    (0.5 without probes). Fields are final_answer and clinical_reasoning of the target; a field may get several defects.
    Repeated rows count once; of several rows of a source_id any that has the defect gives it. Without a candidate or
    case_text, copy and language are not judged. A null target has two empty fields. Rows with a null source_id are named
    null. Extra columns are dropped.
    """
    spark = audited.sparkSession
    fields = audited.select("source_id", F.explode(F.create_map(F.lit("final_answer"), F.col("target.final_answer"), F.lit("clinical_reasoning"), F.col("target.clinical_reasoning"))).alias("field", "text")).distinct()
    case = candidate.where("source_id is not null and case_text is not null").groupBy("source_id").agg(F.max("case_text").alias("case_text"))
    x = fields.join(case, "source_id", "left").select("source_id", "field", "text", "case_text", F.lit(None).cast("int").alias("probe"))
    x = materialize(x.withColumn("no", F.xxhash64("source_id", "field", "text").cast("string")), "fields")
    some = x.where("case_text is not null").orderBy(F.xxhash64("no"), "no").limit(0 if cutoff is not None else probes).select("field", "text", "case_text").collect()
    true = planted([tuple(r) for r in some])
    if true:
        extra = spark.createDataFrame([(f, t, c, n, f"probe {n}") for n, f, t, c, _ in true], "field string, text string, case_text string, probe int, no string")
        x = x.unionByName(extra.withColumn("source_id", F.lit(None).cast("string")))
    cut = truncated_values(x.withColumn("planted", F.col("probe").isNotNull()), "field", "no", "text", "planted").withColumn("cut", F.lit(True))
    x = x.join(cut, ["field", "no"], "left").select("source_id", "field", "probe", "text", "case_text", F.coalesce("cut", F.lit(False)).alias("cut"))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [[_code(v) for v in _votes(t, c, k)] for t, c, k in zip(b["text"], b["case_text"], b["cut"].tolist(), strict=True)]
            yield pd.concat([b[["source_id", "field", "probe"]].reset_index(drop=True), pd.DataFrame(got, columns=list(DEFECTS), dtype="int8")], axis=1)

    votes = materialize(x.mapInPandas(vote, "source_id string, field string, probe int, " + ", ".join(f"{d} tinyint" for d in DEFECTS)), "votes")
    wide = votes.where("probe is null").groupBy(*DEFECTS).count()
    seen = wide.select("count", F.explode(F.create_map(*[c for d in DEFECTS for c in (F.lit(d), F.col(d))])).alias("defect", "code")).groupBy("defect", "code").agg(F.sum("count").alias("n")).collect()  # at most 27 patterns a defect
    tested = {r["probe"]: r for r in votes.where("probe is not null").collect()}
    hits = []
    for d in DEFECTS:
        n = np.zeros(27)
        for r in seen:
            if r["defect"] == d:
                n[r["code"]] = r["n"]
        post = label_model(_PATTERNS, n)
        limit = 0.5 if cutoff is None else cutoff
        if tested:
            limit = best_cutoff(post[[tested[no][d] for no, *_ in true]], np.array([t[-1] == d for t in true]))
        p = F.element_at(F.array(*[F.lit(float(v)) for v in post]), F.col(d).cast("int") + 1)
        hits.append(F.when(p > limit, F.struct(F.lit(d).alias("defect"), p.alias("posterior"))))
    found = votes.where("probe is null").select("source_id", "field", F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return found.groupBy("source_id", "field", F.col("h.defect").alias("defect")).agg(F.max("h.posterior").alias("posterior"))


def first_defect(defects: DataFrame) -> DataFrame:
    """``source_id, field, defect``: of several defects of a field the first in the order of ``DEFECTS``."""
    rank = F.array_position(F.array(*[F.lit(d) for d in DEFECTS]), F.col("defect"))
    return defects.groupBy("source_id", "field").agg(F.min_by("defect", rank).alias("defect"))
