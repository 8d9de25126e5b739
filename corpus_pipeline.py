"""The corpus pipeline: documents in, encoded mix out.

Each stage is (name, function of (spark, docs, sf_dir)); its result is written as
Parquet and read again as the next one's docs, and what lies before is removed; the
last stage's input stays, since its result is read from there when it is used.
Languages are learnt from the documents table itself, from all of its labelled texts.

Defined results, in every stage: an empty table gives an empty one; null and empty
texts go in the first stage (they have no letter); rows that repeat are documents of
their own up to near_copies, where rows of one doc_id are one document, and rows
without doc_id all stay; columns beyond those of documents are left out, so none
clashes; ties are broken by doc_id.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import jaccard, langid, linededup, mixing, piece_bpe
from corpusmill.llm.queries import model_file
from corpusmill.session import remove, shared_folder, ship, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined stay, and a null lang becomes the language found (operator 8).

    Texts without a letter go, and those of 200 bytes and more that no tree codes in
    1.6 times the bits a byte that 99 % of the labelled texts need at most: other
    languages and noise. Trees and limit come from all labelled texts.
    """
    ship(spark)
    trees = langid.train(docs, sample_docs=None)
    return langid.keep_identified(docs.select(*COLUMNS), trees, most_bits=langid.usual_bits(docs, trees), lang_col="lang")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines of a source are cut out of its documents (operator 3); a document of such lines alone stays, with an empty text."""
    return linededup.drop_boilerplate(docs.select(*COLUMNS)).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id; documents without words stay (operator 9)."""
    ship(spark)
    return jaccard.one_of_each(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated, cut and left out so that sources meet their targets (operator 2); those without words go."""
    return mixing.mixed(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document of the mix, with digests of them and of their decoded text (operator 10)."""
    ship(spark)
    return piece_bpe.encode_with_digests(docs, model_file())


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: Language models, shingle joins and encoding have no SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two of them is written in the shared folder, and removed once the next one is written (but for the last stage's input)."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
        if before:
            remove(spark, before)
        before = f"{base}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
