"""The registered queries of this subpackage, each over its whole table, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from salesmart.llm import (
    ann, decontam, divergence, frames, jaccard, packing, quality, rules, secret_scan, sharding, suffixes, toolcalls,
    toxicity,
)
from salesmart.llm.common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query and, when SQL can express it, its check."""
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build
    return register


@query("op1_shortest_pack_first")
def op1_shortest_pack_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])


@query("op2_cross_polytope")
def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector."""
    return ann.nearest(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


#: the tool that the conversations are read as calls of
TOOLS = {"answer": {"type": "object", "required": ["query", "turn"], "additionalProperties": False, "properties": {
    "query": {"type": "string", "minLength": 1}, "size": {"type": "integer", "minimum": 0}, "turn": "integer"}}}


@query("op3_tool_calls")
def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as calls and results: what a user says is a call, what the assistant says next its result.

    A call refers to one at about half its turn, so the order is a tree in every conversation.  Turns of
    other roles are plain messages, and repeated identifiers rows of their own.
    """
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    earlier = F.expr("turn div 4 * 2 + turn % 2")
    calls = turns.where("role = 'user'").select(
        "conv_id", F.concat(F.lit("call_"), "turn").alias("call_id"), F.col("turn").alias("position"),
        F.lit("answer").alias("name"),
        F.to_json(F.struct(F.col("text").alias("query"), F.length("text").alias("size"), "turn")).alias("arguments"),
        F.when(earlier < F.col("turn"), F.array(F.concat(F.lit("call_"), earlier))).otherwise(
            F.array().cast("array<string>")).alias("refers"))
    results = turns.where("role = 'assistant'").select(
        "conv_id", F.concat(F.lit("call_"), F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"),
        F.col("text").alias("content"))
    others = turns.where("role IS NULL OR role NOT IN ('user', 'assistant')").select(
        "conv_id", F.col("turn").alias("position"), "role", F.col("text").alias("content"))
    linked = toolcalls.link_tool_calls(calls, results, TOOLS)
    further, plain = toolcalls.further_messages(calls, results, TOOLS), toolcalls.plain_messages(others)
    return linked.unionByName(further).unionByName(plain)


@query("op4_ngram_jaccard")
def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its near-duplicates and the number of its links."""
    return jaccard.jaccard_classes(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", "class_id", "n_links")


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts and a digest of the base kinds, and all spans."""
    return secret_scan.scan_secrets(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"])


@query("op6_histogram_shards")
def op6_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of near equal bytes, in the order of their ids."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.histogram_shards(docs, "doc_id", "size", 24).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query("op7_benchmark_leaks")
def op7_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return decontam.find_leaks(table(spark, sf_dir, "documents", "doc_id", "text"),
                               table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op8_suffix_dedup")
def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 50 bytes and more that stand in an earlier one."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; a fifth of the labels is held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", fold("doc_id", 5) == 0)
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(fold("doc_id", 5) != 0)
    model = toxicity.train_toxicity(docs.where("NOT held_out"), labels)
    return toxicity.score_toxicity(docs, model, ["doc_id", "held_out"])


@query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a third of the labels is held out."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", fold("doc_id", 3) == 1)
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(fold("doc_id", 3) != 1)
    model = quality.train_quality(docs.where("NOT held_out"), labels)
    return quality.score_quality(docs, model, ["doc_id", "held_out"])


#: kept terms of each language, and their shares in every (lang, source), as integers without bounds
DIVERGENCE_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
    translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, COUNT(*) AS total FROM words GROUP BY ALL HAVING COUNT(DISTINCT r) >= 10),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, COUNT(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL),
grid AS (
  SELECT s.lang, s.source, k.term, k.total, COALESCE(c.n, 0) AS n
  FROM sources s JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)),
shares AS (
  SELECT lang, source, term, n,
    1 + (1000000000::HUGEINT * (n + 2)) // (SUM(n) OVER own + 2 * COUNT(*) OVER own) AS p,
    1 + (1000000000::HUGEINT * (total + 2)) // (SUM(total) OVER own + 2 * COUNT(*) OVER own) AS q
  FROM grid WINDOW own AS (PARTITION BY lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, SUM(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, COALESCE(p.value, 0) AS value
  FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM shares WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM found)
WHERE part = 'pair' OR rank <= 10"""


@query("op11_source_divergence", DIVERGENCE_SQL)
def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each source says more than its language does, and how far it is from the other sources."""
    return divergence.audit_sources(table(spark, sf_dir, "documents", "text", "lang", "source"))


@query("op12_seekable_fim", """
WITH docs AS (
  SELECT doc_id, COALESCE(text, '') AS text, length(COALESCE(text, '')) AS n,
    sha256('1:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (
  SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS one, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS two,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR CAST('0x' || h[17:24] AS BIGINT) % 100 >= 90 THEN 'plain'
      WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM docs),
cut AS (
  SELECT doc_id, n, form, text, LEAST(one, two) AS a, GREATEST(one, two) AS b, substring(text, 1, LEAST(one, two)) AS prefix,
    substring(text, LEAST(one, two) + 1, GREATEST(one, two) - LEAST(one, two)) AS middle,
    substring(text, GREATEST(one, two) + 1) AS suffix FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut""")
def op12_seekable_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents rearranged for fill-in-middle, as digests of the outputs and of the texts rebuilt from them."""
    stored = frames.draw(frames.store(table(spark, sf_dir, "documents", "doc_id", "text")))
    return frames.digests(frames.fill_in_middle(stored)).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


#: the measures and the default rules; windows of three words are counted within each text
RULES_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, COALESCE(text, '') AS text FROM documents),
parts AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
windows AS (
  SELECT r, spot, COUNT(*) OVER (PARTITION BY r, w) AS copies FROM (
    SELECT r, spot, words[spot:spot + 2] AS w
    FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS spot FROM parts WHERE len(words) >= 3))),
covered AS (
  SELECT r, COUNT(DISTINCT spot + k) AS n FROM windows, range(0, 3) AS steps(k) WHERE copies > 1 GROUP BY r),
counts AS (
  SELECT p.*, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, COALESCE(c.n, 0) AS n_repeat_words,
    length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters,
    length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS capitals
  FROM parts p LEFT JOIN covered c ON p.r = c.r),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    word_chars < 2 * n_words OR word_chars > 12 * n_words OR n_symbols * 100 > n_words * 20
    OR n_dup_lines * 100 > len(lines) * 30 OR capitals * 100 > letters * 60
    OR (word_chars - letters) * 100 > word_chars * 50
    OR len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\t]*[-\x{2022}\x{25CF}\x{25E6}*][\x20\t]'))) * 100
      > len(lines) * 90
    OR len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|\x{2026})[\x20\t\r]*$'))) * 100 > len(lines) * 30
    OR contains(lower(text), 'lorem ipsum') OR len(list_distinct(words)) * 100 < n_words * 2 AS rejected
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept
FROM judged"""


@query("op13_quality_cascade", RULES_SQL)
def op13_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the verdict of the default rules on every document."""
    return rules.apply_rules(table(spark, sf_dir, "documents", "doc_id", "text")).select(
        "doc_id", *rules.MEASURES, "base_failed", "kept")


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
