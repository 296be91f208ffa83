"""A training corpus from raw documents: reject toxic ones, keep one of each near-duplicate class, redact personal data,
mix sources to their weights, pack into sequences.

Every stage takes (spark, docs, folder of the tables) and works on all rows its predecessor kept. All but the last
return the columns of the documents. Rows are told apart by their own numbers, so ids may be null or repeated: of the
rows of one class, one stays. A mixed document is there as often as the mix takes it. The last stage returns pieces with their token ids,
so that the packed text is there whatever the ids of the documents are.

Defined cases: extra columns pass through under any name. Null and empty texts are harmless unless labels say otherwise, one class, without
personal data, without words to mix; an empty document that is mixed is one end token. Texts may be of any length. An empty table gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadlake.llm.common import numbered, table
from leadlake.llm.mixing import mix_sources, repeated
from leadlake.llm.near_dedup import near_duplicates
from leadlake.llm.packing import pack_documents
from leadlake.llm.pii import redact
from leadlake.llm.toxicity import score_toxicity
from leadlake.session import materialize, tune


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_toxicity(docs, table(tune(spark), sf_dir, "labels"))
    return scored.where("predicted = 0").select("document.*")


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    rows = numbered(docs, "near-rows")
    kept = near_duplicates(rows.select("row", "document.doc_id", "document.text"), row="row").where("kept").select("row")
    return rows.join(kept, "row", "left_semi").select("document.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return redact(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    rows = numbered(docs, "mix-rows")
    mixed = mix_sources(rows.select("row", "document.doc_id", "document.text", "document.source"), row="row")
    return repeated(rows, mixed, "row").select("document.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tune(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each_class),
    ("pii", redact_personal_data),
    ("mixing", mix_to_weights),
    ("packing", pack),
]

# Trees, sketches and the tokenizer have no SQL form; tests/llm/test_pipeline.py compares stages and run with plain Python (not fitted trees).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
