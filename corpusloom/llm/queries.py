"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import embeddup, langid, minhash, mixing, packing, pii, quality, sharding, spotsigs, toxicity
from corpusloom.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The word class of textkit.WORD_RE in RE2 syntax.
_WORDS = r"regexp_extract_all(lower(text), '[^\x00-/:-@\[-\^`{-\x7f]+')"


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = minhash.near_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "group_id", "group_size", "keep")


ORACLES["op1_minhash"] = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) >= {minhash.N} THEN list_transform(range(1, len(ws) - {minhash.N - 2}),
      lambda i: array_to_string(ws[i:i + {minhash.N - 1}], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s
  FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE c / CAST(x.n + y.n - c AS DOUBLE) >= {minhash.THRESHOLD}),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a),
m AS (SELECT a AS doc_id, min(b) AS group_id FROM reach GROUP BY 1)
SELECT doc_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, doc_id = group_id AS keep FROM m
"""


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


ORACLES["op3_sharding"] = sharding.oracle()


@query
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@query
def op8_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"), fallback=True)


@query
def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op10_embeddup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddup.near_groups(table(spark, sf_dir, "embeddings"))


ORACLES["op10_embeddup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
both_ways AS (
  SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.vec_id != y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= {embeddup.THRESHOLD}),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT r.a, t.b FROM reach r JOIN both_ways t ON r.b = t.a),
m AS (SELECT a AS vec_id, min(b) AS group_id FROM reach GROUP BY 1)
SELECT vec_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, vec_id = group_id AS keep FROM m
"""
