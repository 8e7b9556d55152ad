"""The registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from .importance import SQL as IMPORTANCE_SQL
from .lines import SQL as LINES_SQL
from .mixing import SQL as MIXING_SQL


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bpe(spark, sf_dir):
    from .bpe import round_trip
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return round_trip(docs, tokenizer_path()).drop("ids")


def op10_simhash(spark, sf_dir):
    from .simhash import near_duplicates
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    out = near_duplicates(docs, shingle=3, radius=2)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op2_lm_scoring(spark, sf_dir):
    from .lm_scoring import score
    return score(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                 table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def op3_line_dedup(spark, sf_dir):
    from .lines import dedup
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return dedup(docs)


def op4_rule_ensemble(spark, sf_dir):
    from .rule_ensemble import held_out_scores
    return held_out_scores(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                           table(spark, sf_dir, "labels", ["doc_id", "quality"]))


def op6_quality_rules(spark, sf_dir):
    from .quality_rules import fit, judge
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    return judge(docs, fit(docs, table(spark, sf_dir, "labels", ["doc_id", "quality"])))


def op5_mixing(spark, sf_dir):
    from .mixing import mix
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    return mix(docs)


def op7_licenses(spark, sf_dir):
    from .licenses import scan
    return scan(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def op8_toxicity(spark, sf_dir):
    from .toxicity import held_out_scores
    return held_out_scores(table(spark, sf_dir, "documents", ["doc_id", "text"]),
                           table(spark, sf_dir, "labels", ["doc_id", "toxic"]))


def op9_cap_filters(spark, sf_dir):
    from .vectors import near_duplicates
    vecs = table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return near_duplicates(vecs, least=0.9).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op11_periodic_runs(spark, sf_dir):
    from .periodic import digest, runs, with_loops
    return digest(runs(with_loops(table(spark, sf_dir, "documents", ["doc_id", "text"]))))


def op12_importance(spark, sf_dir):
    from .importance import resample
    return resample(table(spark, sf_dir, "documents", ["doc_id", "text"]), table(spark, sf_dir, "benchmark", ["text"]))


def op13_sharding(spark, sf_dir):
    from .sharding import shard
    return shard(table(spark, sf_dir, "documents", ["doc_id", "text"]))


REGISTRY = {f.__name__: f for f in (
    op1_bpe, op2_lm_scoring, op3_line_dedup, op4_rule_ensemble, op5_mixing, op6_quality_rules, op7_licenses,
    op8_toxicity, op9_cap_filters, op10_simhash, op11_periodic_runs,
    op12_importance, op13_sharding)}

ORACLE: dict[str, str] = {"op3_line_dedup": LINES_SQL, "op5_mixing": MIXING_SQL,
                          "op12_importance": IMPORTANCE_SQL}
