"""Registered queries of the training-data operators: one per dealt operator, over whole tables, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswire.llm import common

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return put


OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS k FROM d, unnest(range(1, len(w) - 18)) AS t(i)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM windows)
          WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM later, unnest(range(0, 20)) AS u(j)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text
         FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP1_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                     WHERE label IS NOT NULL AND len(embedding) > 0
                       AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                       AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, len(e) AS dim, e, sqrt(list_dot_product(e, e)) AS norm FROM v),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM u a JOIN u b USING (label, dim)
          WHERE a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings
          UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
SELECT x AS vec_id, CAST((SELECT count(*) FROM links WHERE links.x = reach.x) AS BIGINT) AS n_links,
       min(y) AS component_id, x = min(y) AS kept FROM reach GROUP BY x
"""


@query("op3_feistel_shards")
def op3(spark, sf_dir):
    from presswire.llm.sharding import feistel_shards
    return feistel_shards(common.documents(spark, sf_dir))


@query("op5_sainte_lague_mix")
def op5(spark, sf_dir):
    from presswire.llm.mixing import sainte_lague_mix
    return sainte_lague_mix(common.documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken")


@query("op7_cutting_stock_packing")
def op7(spark, sf_dir):
    from presswire.llm.packing import pack_sequences
    return pack_sequences(common.documents(spark, sf_dir))


@query("op8_gray_simhash")
def op8(spark, sf_dir):
    from presswire.llm.simhash import simhash_groups
    return simhash_groups(common.documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


@query("op9_dac_tokens")
def op9(spark, sf_dir):
    from presswire.llm.dac import dac_tokens
    return dac_tokens(common.documents(spark, sf_dir))


@query("op10_compression_bands")
def op10(spark, sf_dir):
    from presswire.llm.quality import quality_rules
    return quality_rules(common.documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "ratio", "n_chunks", "n_bad_chunks")


@query("op4_crf_secrets")
def op4(spark, sf_dir):
    from presswire.llm.secrets import scan_secrets
    return scan_secrets(common.documents(spark, sf_dir)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_crf")


@query("op2_surrogates")
def op2(spark, sf_dir):
    from presswire.llm.surrogates import replace_private
    return replace_private(common.documents(spark, sf_dir)).select(
        "doc_id", "text", "n_email", "n_ip", "n_ssn", "n_phone", "n_card", "n_name")


@query("op1_nn_descent", OP1_SQL)
def op1(spark, sf_dir):
    from presswire.llm.nndescent import near_vectors
    from presswire.sources.tables import read_table
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


@query("op6_phrase_automata", OP6_SQL)
def op6(spark, sf_dir):
    from presswire.llm.passages import repeated_passages
    return repeated_passages(common.documents(spark, sf_dir))


@query("op11_merge_path_alignment")
def op11(spark, sf_dir):
    from presswire.llm.alignment import align_tokens
    return align_tokens(common.documents(spark, sf_dir)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op12_offset_pieces")
def op12(spark, sf_dir):
    from presswire.llm.pieces import decode_pieces, encode_pieces
    return decode_pieces(encode_pieces(common.documents(spark, sf_dir))).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.sha2(F.concat("begins", "ends"), 256).alias("spans_sha256"))


@query("op13_spectrum_slicing")
def op13(spark, sf_dir):
    from presswire.llm.whitening import whiten
    from presswire.sources.tables import read_table
    return whiten(read_table(spark, sf_dir, "embeddings"))
