"""The registered queries: each operator over its whole table, reduced to its digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.llm.alignment import align_tokenizers
from leadlake.llm.common import id_bucket, table
from leadlake.llm.embeddings import near_vectors
from leadlake.llm.lm import score_texts
from leadlake.llm.mixing import mix_sources
from leadlake.llm.near_dedup import near_duplicates
from leadlake.llm.packing import pack_documents
from leadlake.llm.periodic import find_runs, run_digests, with_periodic_tail
from leadlake.llm.pii import digest, find_personal_data
from leadlake.llm.quality import BOILERPLATE, MENU, TERMINAL, clean_lines
from leadlake.llm.quality_vectors import score_quality
from leadlake.llm.repeats import remove_repeats
from leadlake.llm.sharding import kd_shards
from leadlake.llm.toxicity import score_toxicity


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op3_pca_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept", "class_size")


def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = id_bucket("doc_id", 5)
    return score_texts(table(spark, sf_dir, "documents"), fold != 1, fold == 0)


def op6_context_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_personal_data(table(spark, sf_dir, "documents")))


def op7_pack_powers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_toxic_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_bucket("doc_id", 4) == 2
    learned = table(spark, sf_dir, "labels").where(~held_out)
    return score_toxicity(table(spark, sf_dir, "documents"), learned).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "leaf_path")


def op11_hash_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", with_periodic_tail(F.col("text"), F.col("doc_id")).alias("text"))
    return run_digests(find_runs(documents, min_length=12, keep=["doc_id"]))


def op13_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_bucket("doc_id", 3) == 1
    learned = table(spark, sf_dir, "labels").where(~held_out)
    scored = score_quality(table(spark, sf_dir, "documents"), learned, keep=["doc_id"]).select("document.doc_id", "score", "predicted")
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_suffix_repeats, op3_pca_tiles, op4_order_minhash, op5_deleted_interpolation, op6_context_pii, op7_pack_powers, op8_toxic_trees, op9_quality_lines, op10_kd_shards, op11_hash_alignment,
                                   op12_lyndon_runs, op13_subword_quality)}


TERMINAL_SQL = "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in TERMINAL) + "]"
_SPACE = "[\\x20\\x09-\\x0D]"
ORACLES: dict[str, str] = {
    "op3_pca_tiles": """
        with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
        links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
        reach as (select vec_id, vec_id as r from v union select reach.vec_id, b from reach join links on a = r)
        select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
        from (select vec_id, min(r) as component_id from reach group by 1) c left join (select a as vec_id, count(*) as n from links group by 1) l using (vec_id)""",
    "op9_quality_lines": f"""
        with body as (select doc_id, coalesce(text, '') as body from documents),
        parts as (select doc_id, body, list_filter(regexp_split_to_array(body, '{_SPACE}+'), lambda x: x <> '') as words,
                         list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from body),
        base as (select doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
                        (length(body) - length(translate(body, '#*$%&|<>', '')))::bigint as n_symbols,
                        (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines from parts),
        windows as (select doc_id, i, words[i] as a, words[i + 1] as b, words[i + 2] as c from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from parts) p),
        twins as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, a, b, c) as n from windows) w where n > 1),
        repeats as (select doc_id, count(distinct i + k) as n from twins, (select unnest([0, 1, 2]) as k) k group by 1),
        each as (select doc_id, unnest(lines) as line from parts),
        total as (select doc_id, sum(length(line)) as chars from each group by 1),
        judged as (select doc_id, line, lower(line) as low from (select distinct doc_id, line from each) e),
        good as (select doc_id, sum(length(line)) as chars from judged where not (
            (not list_contains({TERMINAL_SQL}, right(rtrim(low, ' '), 1)) and len(regexp_split_to_array(trim(low, ' '), '{_SPACE}+')) < 5)
            or length(low) - length(translate(low, '#*$%&|<>{{}}=~^\\', '')) > length(low) * 0.1
            or (upper(line) = line and regexp_matches(line, '\\p{{Lu}}(\\P{{Lu}}*\\p{{Lu}}){{11}}'))
            or length(low) - length(translate(low, '|»›·>', '')) >= 3 or regexp_matches(low, '{MENU}')
            or {" or ".join(f"contains(low, '{phrase}')" for phrase in BOILERPLATE)}) group by 1),
        scored as (select base.*, coalesce(r.n, 0)::bigint as n_repeat_words, n_words < 50 or 100 * coalesce(r.n, 0) > 50 * n_words as base_failed,
                          case when t.chars > 0 then coalesce(g.chars, 0)::double / t.chars::double else 0.0::double end as kept_share
                   from base left join repeats r using (doc_id) left join total t using (doc_id) left join good g using (doc_id))
        select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and kept_share >= 0.5 as kept, kept_share from scored""",
}
