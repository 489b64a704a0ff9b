"""Queries over the llm operators, over whole tables with production parameters, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.capping import cap_contributors, usable_judgments
from lodestream.llm.defects import first_defect, response_defects
from lodestream.llm.duplicates import cross_split, cross_split_pairs, duplicate_pairs, near_duplicates, split_sides
from lodestream.llm.leaks import leaked_items
from lodestream.llm.lookalike import consistent_spans, hidden_spans
from lodestream.llm.mixing import mix_shares, mix_sources
from lodestream.llm.reading import reading_levels
from lodestream.llm.truncation import text_fields, truncated_values, truncation_rates
from lodestream.session import materialize, table

Query = Callable[[SparkSession, str], DataFrame]


def _capped(s: SparkSession, d: str) -> DataFrame:
    return cap_contributors(usable_judgments(table(s, d, "judgment")), "contributor", "pair_id", "confidence", max_count=3)


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return _capped(s, d).where("not kept").select("pair_id")


def p1_contributors(s: SparkSession, d: str) -> DataFrame:
    n = F.count(F.lit(1)).cast("bigint")
    return _capped(s, d).groupBy("contributor").agg(n.alias("pairs"), F.sum(F.col("kept").cast("bigint")).alias("kept"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return duplicate_pairs(table(s, d, "candidate"))


def p2_links(s: SparkSession, d: str) -> DataFrame:
    """One row for each source_id and text: its class of equal texts, the size of that and the number of similar other texts."""
    m, pairs = near_duplicates(table(s, d, "candidate"))
    both = pairs.select(F.col("ckey_a").alias("ckey")).unionByName(pairs.select(F.col("ckey_b").alias("ckey")))
    links = both.groupBy("ckey").agg(F.count(F.lit(1)).alias("links"))
    size = m.groupBy("ckey").agg(F.count(F.lit(1)).alias("copies"))
    x = m.join(size, "ckey").join(links, "ckey", "left")
    return x.select(F.col("id").alias("source_id"), F.lower(F.hex("ckey")).alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return cross_split_pairs(table(s, d, "candidate"))


def p4_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Each overlap with its similarity and, where no stretch has moved far, its edit distance."""
    x = cross_split(split_sides(table(s, d, "candidate")), band=0.4)
    return x.groupBy("eval_id", "train_id", "split").agg(F.round(F.max("jaccard"), 6).alias("jaccard"), F.min("edits").alias("edits"))


def p4_counts(s: SparkSession, d: str) -> DataFrame:
    """Per split and source_file of the evaluation records: records, those with a partner in train, and partners."""
    m = split_sides(table(s, d, "candidate"))
    x = materialize(cross_split(m), "cross-split")
    whole = m.where("split <> 'train'").select("id", "split", "source_file").distinct().groupBy("split", "source_file").agg(F.count(F.lit(1)).alias("records"))
    hit = x.groupBy("split", "source_file").agg(F.count_distinct("eval_id").alias("leaked"), F.count_distinct("eval_id", "train_id").alias("pairs"))
    return whole.join(hit, ["split", "source_file"], "left").select("split", "source_file", "records", F.coalesce("leaked", F.lit(0)).alias("leaked"), F.coalesce("pairs", F.lit(0)).alias("pairs"))


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return truncated_values(text_fields(table(s, d, "documents"), table(s, d, "audited")), "field", "record_key", "text")


def p5_rates(s: SparkSession, d: str) -> DataFrame:
    return truncation_rates(text_fields(table(s, d, "documents"), table(s, d, "audited")))


def p6_found(s: SparkSession, d: str) -> DataFrame:
    return first_defect(response_defects(table(s, d, "audited"), table(s, d, "candidate"))).where("source_id is not null")


def p6_posteriors(s: SparkSession, d: str) -> DataFrame:
    return response_defects(table(s, d, "audited"), table(s, d, "candidate")).withColumn("posterior", F.round("posterior", 6))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return hidden_spans(table(s, d, "audited"), table(s, d, "candidate"))


def p7_spans(s: SparkSession, d: str) -> DataFrame:
    return consistent_spans(table(s, d, "audited"), table(s, d, "candidate")).select("source_id", "evidence_id", "span_same", "case_text_same", "found", "found_same")


def _leaks(s: SparkSession, d: str) -> DataFrame:
    return leaked_items(table(s, d, "documents"), table(s, d, "exam_question"), "doc_id", "text", "id", "question").withColumnRenamed("id", "item_id")


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return _leaks(s, d).where("whole >= 0.5").select("doc_id", "item_id")


def p8_leaks(s: SparkSession, d: str) -> DataFrame:
    return _leaks(s, d)


def p9_mix(s: SparkSession, d: str) -> DataFrame:
    return mix_sources(table(s, d, "documents"), table(s, d, "mix_target"))


def p9_shares(s: SparkSession, d: str) -> DataFrame:
    return mix_shares(p9_mix(s, d), table(s, d, "mix_target"))


def p9_corpus_mix(s: SparkSession, d: str) -> DataFrame:
    """A mix as large as the corpus: small sources are repeated up to their limits, the others fill up."""
    x = table(s, d, "documents")
    return mix_sources(x, table(s, d, "mix_target"), total=1.0, relative=True)


def p9_corpus_shares(s: SparkSession, d: str) -> DataFrame:
    """Wanted and actual shares of the mix that is as large as the corpus, with the most copies of a document."""
    return mix_shares(p9_corpus_mix(s, d), table(s, d, "mix_target"))


def p10_levels(s: SparkSession, d: str) -> DataFrame:
    return reading_levels(table(s, d, "documents"), table(s, d, "reading_label"))


def p10_found(s: SparkSession, d: str) -> DataFrame:
    return p10_levels(s, d).where("level = 5").select("doc_id")


def queries() -> dict[str, Query]:
    own = (p1_found, p1_contributors, p2_found, p2_links, p4_found, p4_overlaps, p4_counts, p5_found, p5_rates, p6_found, p6_posteriors, p7_found, p7_spans, p8_found, p8_leaks, p9_mix, p9_shares, p9_corpus_mix, p9_corpus_shares, p10_found, p10_levels)
    return {f.__name__: f for f in own}


_RANKED = r"""
WITH ok AS (
  SELECT pair_id, lower(regexp_replace(source_id, '^[\s\x{3000}\x{00a0}]+|[\s\x{3000}\x{00a0}]+$', '', 'g')) AS contributor, parsed_judgment.confidence AS q, created_at, loaded_at
  FROM judgment WHERE status = 'ok' AND parsed_judgment.confidence BETWEEN 0 AND 1 AND NOT isnan(parsed_judgment.confidence) AND pair_id IS NOT NULL
), last AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY created_at DESC NULLS LAST, loaded_at DESC NULLS LAST, q DESC, contributor DESC NULLS LAST) AS n FROM ok
), ranked AS (
  SELECT pair_id, contributor, contributor IS NULL OR row_number() OVER (PARTITION BY contributor ORDER BY q DESC, pair_id) <= 3 AS kept FROM last WHERE n = 1
)
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that DuckDB can express; the others need NFKC, tokenizers, automata or iteration."""
    return {
        "p1_found": _RANKED + "SELECT pair_id FROM ranked WHERE NOT kept",
        "p1_contributors": _RANKED + "SELECT contributor, count(*) AS pairs, CAST(sum(CAST(kept AS INT)) AS BIGINT) AS kept FROM ranked GROUP BY contributor",
    }
