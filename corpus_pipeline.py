"""A corpus pipeline over `documents`: language ID, near-duplicates, personal data, mixing, tokens.

Every stage takes what its predecessor kept, as rows of documents, and writes its decisions into them: the first drops
rows and fills in languages, the second drops rows, the third masks spans, the fourth puts the rows in mixing order, the
last adds token counts and digests, and each row's block, phase, slot and place in that order.

Texts of any length are read whole, rows that repeat are one document to the second stage, an empty table gives an empty
one, and columns beyond those of documents are passed through.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bpe, langid, mixing, pii, simhash
from loomspan.llm.common import discard, materialize, named, read


def aside(docs: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """docs with its own columns of these names, in any case, under others, so that an operator may add columns of its own."""
    taken = {c.lower() for c in docs.columns}
    free = next(f"own{'_' * n}" for n in range(1, len(taken) + 2) if not any(c.startswith(f"own{'_' * n}") for c in taken))
    return docs.select(*(named(c).alias(f"{free}{i}" if c.lower() in names else c) for i, c in enumerate(docs.columns)))


def as_before(out: DataFrame, held: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, which are those of held under their first names."""
    return out.select(*(named(x).alias(c) for x, c in zip(held.columns, docs.columns, strict=True)))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a known language and writes it where lang is null; rejects null texts and texts without a letter.

    A table without labels loses only these, and its languages stay null.
    """
    # without labels no language is known; one made-up profile then stands for any
    held = aside(docs, ("lang_pred", "lang_score"))
    out = langid.predict(held, langid.profiles(docs) or {"": np.zeros(1, np.int64)}).where(F.col("lang_pred") != langid.UNKNOWN)
    return as_before(out.withColumn("lang", F.coalesce(F.col("lang"), F.nullif(F.col("lang_pred"), F.lit("")))), held, docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates, the least id; empty texts and null ids as in simhash.representatives."""
    return as_before(simhash.representatives(docs), docs, docs)


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars is counted again. A null text stays null, an empty table gives an empty one."""
    held = aside(docs, ("spans",))
    found = pii.detect(held)
    text = F.when(F.col("text").isNotNull(), pii.redacted(F.col("text"), F.col("spans")))
    out = found.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return as_before(out, held, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all rows in the order of the mixing plan: the files, read in order, hold the sources by their weights. A null source is one as others are.

    Rows of equal ids tie and stand in any order among themselves; an empty table gives an empty one.
    """
    held = aside(docs, ("block", "phase", "slot", "place"))
    return as_before(mixing.mix(held).orderBy("slot", "place"), held, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their places in the mixing plan, token counts and the digests of ids and of the decoded text.

    Files do not keep an order when Spark reads them, so the plan is made again: the same rows give the same one. A null
    text has no tokens, rows that repeat get equal ones, and an empty table gives an empty one. Columns of the new names are
    replaced.
    """
    return bpe.encode(mixing.mix(docs))


STAGES = [("language_id", identify), ("near_duplicates", deduplicate), ("personal_data", mask), ("mixing", mix), ("bpe", encode)]

#: No stage but the last two could be given in SQL; the tests hold the whole against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last written to the shared folder and read again.

    A stage's files go once its successor's are written; what the operators write themselves stays.
    """
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
