"""One query per operator over the given tables, in the columns that checks compare."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from topicloom.llm import chunk_bpe, decontam, line_dedup, merkle, oracles, phrases, pii_crf, piece_codec, pitman_yor, quality_llr, rans_store, secret_tests, simhash_trie, toxicity_kn
from topicloom.llm.common import held_out
from topicloom.llm.registry import query, table


@query("op4_simhash_trie")
def op4(spark, sf):
    groups = simhash_trie.near_duplicates(table(spark, sf, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# The oracle counts documents per key plainly; lines are numbered to keep their order.
LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)
),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
gone AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(g.key)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE g.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN gone g USING (key) GROUP BY doc_id
"""


@query("op8_line_dedup", LINES_SQL)
def op8(spark, sf):
    cut = line_dedup.drop_repeated_lines(table(spark, sf, "documents"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query("op2_piece_codec")
def op2(spark, sf):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = piece_codec.encode_and_decode(table(spark, sf, "documents").select("doc_id", "text"), path)
    return piece_codec.digests(coded)


@query("op10_rans_store")
def op10(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    folder = rans_store.write_store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return rans_store.read_store(spark, folder, checksums=True)


@query("op5_decontam")
def op5(spark, sf):
    found = decontam.find_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "item_id", "edits")


@query("op6_toxicity_kn")
def op6(spark, sf):
    settings = toxicity_kn.Settings()
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity_kn.train(docs, table(spark, sf, "labels"), settings)
    scored = toxicity_kn.score(docs, model, settings)
    return scored.select("doc_id", held_out("doc_id", settings.folds, settings.held_out_fold).alias("held_out"), "score", "predicted")


# The base columns in SQL; the ratio's verdict is tested against a brute-force version.
@query("op1_quality_llr")
def op1(spark, sf):
    return quality_llr.score(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op7_secret_tests")
def op7(spark, sf):
    return secret_tests.digests(secret_tests.scan(table(spark, sf, "documents")))


@query("op9_pitman_yor")
def op9(spark, sf):
    return pitman_yor.score(table(spark, sf, "documents"))


@query("op3_pii_crf")
def op3(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii_crf.digests(pii_crf.find(docs, pii_crf.train_field(docs)))


@query("op11_merkle_veb", oracles.MERKLE)
def op11(spark, sf):
    return merkle.verify(merkle.build(table(spark, sf, "documents"), merkle.without_newlines()))


@query("op12_chunk_bpe")
def op12(spark, sf):
    return chunk_bpe.digests(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op13_phrase_graph", oracles.PHRASES)
def op13(spark, sf):
    return phrases.mine(table(spark, sf, "documents"))
