"""A training-data pipeline: documents of poor quality go, of each group of linked documents one stays, sources are mixed to target
weights, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from querncore.llm.common import id_crc, removed, scratch, table, written
from querncore.llm.jaccard_join import keep_one
from querncore.llm.mixing import mixed_rows
from querncore.llm.quality import accepted, learn
from querncore.llm.queries import tokenizer_path
from querncore.llm.unigram import encode_texts


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = learn(docs, table(spark, sf_dir, "labels"), lambda c: id_crc(c) % 5 != 0)
    return accepted(docs, model)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicates: five-word shingles and a similarity of 0.8; the 90 % on three words are op2's own."""
    return keep_one(docs, percent=80, width=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return encode_texts(docs, tokenizer_path("piece_bpe_32k.model"), keep=("doc_id", "source")).drop("decoded")


#: Each takes (spark, docs, sf_dir); each gets all that the one before has kept.
STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", jaccard_join), ("mixing sources to target weights", mix_sources), ("SentencePiece encoding and decoding", encode)]

#: SQL can express neither the classifier nor the draw.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's rows are written to the shared folder and read again, and what
    it wrote besides goes."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        before = docs
        with scratch(spark):
            docs = written(stage(spark, before, sf_dir), name.split()[0].lower())
        if k:
            removed(before)
    return docs
