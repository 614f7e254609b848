"""From raw documents to training tokens: quality, near duplicates, benchmark leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame. All but the last
return the columns of ``documents``, with whatever further columns ``docs`` has, under any names; the last returns one row
of tokens per document that is left. An empty table gives an empty one at every stage. Repeated rows are judged each,
and the near duplicates stage leaves one of them. Texts of any length are taken whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeline.llm.bpe import encode_documents
from tapeline.llm.common import materialize, table
from tapeline.llm.decontaminate import drop_leaks
from tapeline.llm.jaccard import keep_one
from tapeline.llm.pseudonyms import pseudonymize, secret_key
from tapeline.llm.quality import filter_quality
from tapeline.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's perplexity limits.

    Null and empty texts go; a null language has limits of its own; rows of ``labels`` with nulls are not trusted, and
    without trusted documents all other texts stay. A text at a limit stays.
    """
    return filter_quality(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at a Jaccard similarity of 0.8.

    Of a group the smallest id stays, null ids first; of rows with one id and text one, chosen by a hash of the other
    columns. Null texts and texts without words are linked with nothing and stay.
    """
    return keep_one(docs, n=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark. Null and empty texts stay; items without words match nothing."""
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms in place of personal values. Null stays null; equal values get equal pseudonyms in all rows.

    The key is the session's setting ``spark.tapeline.pseudonym.key``, or else one that the application draws for itself.
    """
    return pseudonymize(docs, secret_key(spark)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the checksums of the ids and of the text they decode to. A null text has no tokens."""
    got = encode_documents(docs, tokenizer_path(), with_ids=True)
    return got.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("tokens", tokens),
]

#: Perplexity, pseudonyms and BPE are not expressible in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
