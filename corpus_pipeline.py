"""A corpus pipeline over ``documents``: quality, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's documents. All but the last keep all columns, whatever their names,
and empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import _util, bestfit, decontaminate, ngram_join, quality


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on ``labels``, does not reject.

    Null and empty texts get the score of a text without words; repeated rows go or stay together;
    without labels every document stays; texts of any length are scored whole.
    """
    weights = quality.train(docs, _util.read(spark, sf_dir, "labels"))
    return quality.accept(docs, weights)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (five words, similarity 0.8), of the least doc_id.

    Rows without doc_id stay, and of repeated rows with doc_id one stays; null and empty texts are no
    near duplicates; a text stays when no other of its class does, also where its doc_id has other texts.
    """
    return ngram_join.dedupe(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages: contaminated ones (a word in twenty) go, lighter hits are cut out.

    Null and empty texts stay as they are; repeated rows go or stay together; null items hit nothing.
    """
    return decontaminate.clean(docs, _util.read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids in sequences of the permitted lengths; ``pieces`` keeps their columns.

    Null and empty texts have the end token only; repeated rows are packed each; longer texts are cut into pieces.
    """
    import public_tokenizers

    return bestfit.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", good_quality), ("near_duplicates", near_duplicates), ("decontaminate", benchmark_free), ("pack", packed)]

#: SQL expresses neither the classifier nor tokens; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _util.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = _util.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
