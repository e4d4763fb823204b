"""The training-data pipeline: stages over ``documents``, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomcorpus.llm import line_dedup, mixing, packing, simhash, toxicity
from loomcorpus.llm.queries import table, tokenizer_path
from loomcorpus.llm.shared import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score as toxic; the others stay as they are."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "stage-toxicity"))
    return toxicity.without_toxic(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that repeat an earlier one; every document stays, if need be empty."""
    return line_dedup.cleaned(docs, Scratch(spark, "stage-lines"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: that with the smallest id."""
    return simhash.kept_documents(docs, Scratch(spark, "stage-copies"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources have their target weights."""
    return mixing.mixed_documents(docs, Scratch(spark, "stage-mix"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenizes the mix and packs it into sequences; one row per piece."""
    return packing.packed(docs, tokenizer_path(), Scratch(spark, "stage-pack")).drop("filled")


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_lines), ("simhash near-dedup", drop_copies), ("mix sources", mix_sources), ("best-fit packing", pack_sequences)]

#: A trained score, MinHash and tokenizer ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies every stage to documents; each result is written before the next stage reads it.

    What a stage kept for itself, and the result before it, is deleted once its own is written.
    """
    docs, before = table(spark, sf_dir, "documents"), list(Scratch.made)
    for name, stage in STAGES:
        scratch = Scratch(spark, "pipeline-" + name.replace(" ", "-"))
        docs = scratch.keep(stage(spark, docs, sf_dir))
        for other in [x for x in Scratch.made if x not in before and x is not scratch]:
            other.drop()
    return docs
