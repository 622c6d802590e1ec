"""The corpus pipeline: five stages over documents, each with one operator of loomquest.llm.

Every stage but the last returns rows with the columns of its input, whatever else they hold: columns whose names an operator uses for its own results are
carried past it. Null and empty texts are documents without words, which the first stage rejects; long texts are taken whole; repeated rows are
handled alike up to the second stage, which leaves one of them; an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomquest.llm import op1_pii, op4_mix, op6_pieces, op7_quality, op9_simhash
from loomquest.llm.common import new_path
from loomquest.llm.queries import tokenizer_path

#: The encoder's workers share executors with what earlier stages left in the JVM, so they keep fewer units and take less text at a time than op6 does by itself.
ENCODER_CACHE, ENCODER_CHARS = 24 << 20, 1 << 20
#: Columns that operators read or write in place; all others go past them as one.
_READ = ["doc_id", "text", "source", "n_chars"]


def _past(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that stage gives of docs, with all columns of docs, of which stage sees those of _READ alone."""
    read, rest = [c for c in docs.columns if c in _READ], [c for c in docs.columns if c not in _READ]
    seen = docs.select(*read, *([F.struct(*rest).alias("__rest")] if rest else []))
    return stage(seen).select(*[F.col(f"__rest.`{c}`").alias(c) if c in rest else c for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or their host's verdict reject go: those without text or with fewer than 20 words among them. A null source is a host of its own."""
    return _past(docs, lambda d: op7_quality.judged(d).where("kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest doc_id: texts whose sets of five-word shingles are similar by 0.8 or more. Null ids
    come after all others; of rows that repeat an id the one whose text hashes lowest stays."""
    return _past(docs, op9_simhash.deduped)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; n_chars follows. Texts without any, and null ones, stay as they are."""
    return _past(docs, op1_pii.redacted)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target weights: a document can come up to three times, and one of each source may be cut. Documents without words come never; a null source is a
    source of its own, the last."""
    return _past(docs, op4_mix.mix_rows)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document of the mix, with the N best scores and whether they decode to the text. Null and empty texts have no pieces."""
    return op6_pieces.encoded(docs, tokenizer_path("piece_bpe_32k.model"), ["doc_id", "source"], cache=ENCODER_CACHE, chars=ENCODER_CHARS)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("pii", pii), ("mix", mix), ("encode", encode)]
#: Fingerprints need XXH64, which SQL here lacks; tests hold the rows against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
