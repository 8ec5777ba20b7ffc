"""One query per operator: the operator over its whole table, reduced to the contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, langid, minhash, nbsvm, negatives, pack, rules, substrings, suffixtree, tokenfiles, toxic, whitening
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out("doc_id", 4, 2)))
    return langid.predict(docs, model).withColumn("held_out", held_out("doc_id", 4, 2))


@query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = nbsvm.train(docs, labels.where(~held_out("doc_id", 4, 2)))
    scored = nbsvm.score(docs, model)
    return scored.withColumns({"held_out": held_out("doc_id", 4, 2), "predicted": (F.col("score") >= 0.7).cast("int")})


@query
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxic.train(docs, labels.where(~held_out("doc_id", 5, 0)))
    scored = toxic.score(docs, model)
    return scored.withColumns({"held_out": held_out("doc_id", 5, 0), "predicted": (F.col("score") >= 0.5).cast("int")})


@query
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model, word_counts = suffixtree.train(docs.where(~held_out("doc_id", 7, 2)))
    return suffixtree.score(docs, model, word_counts).withColumn("held_out", held_out("doc_id", 7, 2))


@query
def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removals(table(spark, sf_dir, "documents")).drop("spans")


@query
def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    judged = rules.judge(docs, rules.train(docs, labels))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    mislabelled = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.select("vec_id", mislabelled.alias("label"), "embedding"), F.col("vec_id") % 100 == 0)


ORACLES["op11_hard_negatives"] = """
with r as (
  select row_number() over () as uid, vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v,
    case when vec_id % 7 = 0 then (cast(label as bigint) + 1) % 10 else label end as lab
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select a.uid, a.vec_id as anchor_id, b.uid as other, b.vec_id as other_id, a.lab = b.lab as same, cast(list_inner_product(a.v, b.v) as bigint) as score
  from r a join r b on len(a.v) = len(b.v) and a.uid <> b.uid where a.vec_id % 100 = 0
), positive as (
  select uid, anchor_id, other, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by uid order by score desc, other_id nulls last) <= 5
)
select p.anchor_id, p.positive_id, cast(row_number() over (partition by p.uid, p.other order by s.score desc, s.other_id nulls last) as integer) as rank,
  s.other_id as negative_id, p.positive_score, s.score as negative_score
from positive p join scored s on p.uid = s.uid and not s.same and 30 * p.positive_score <= 100 * s.score and 100 * s.score <= 90 * p.positive_score
qualify rank <= 10
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = tokenfiles.written(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return tokenfiles.digests(index, folder)
