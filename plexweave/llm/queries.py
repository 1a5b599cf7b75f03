"""The registered queries: each applies one operator to its whole table and derives the columns asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexweave.llm.common import bound_batches, table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexweave.llm.toxicity import fit, scored

    docs = table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexweave.llm.near_dedup import near_groups

    return near_groups(table(spark, sf_dir, "documents"))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexweave.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexweave.llm.langid import fit, identified

    docs = table(spark, sf_dir, "documents")
    return identified(docs, fit(docs))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexweave.llm.html_text import main_text

    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexweave.llm.mixing import mixed

    plan = mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "position")
    return plan.orderBy("position", "doc_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexweave.llm.substring_dedup import kept_words, with_kept

    digest = lambda words, gone: (len(words), int(gone.sum()), sha256(b" ".join(kept_words(words, gone))).hexdigest())
    return with_kept(table(spark, sf_dir, "documents"), digest, "n_words long, n_removed long, kept_sha256 string")


def op8_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file of the directory source/lang."""
    from plexweave.llm.licences import licence_scan

    docs = table(spark, sf_dir, "documents")
    return licence_scan(docs.select("doc_id", "text", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexweave.llm.exact_dedup import exact_groups

    return exact_groups(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are taken batch by batch where ids and decoded texts are made, so neither crosses to the JVM."""
    from plexweave.llm.bpe import VOCABULARY, tokenizer

    bound_batches(spark)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer(public_tokenizers.path(VOCABULARY))
        names = [str(i) for i in range(len(bpe.tokens))]
        for b in batches:
            ids = [bpe.encode(t) for t in b["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "n_tokens": [len(i) for i in ids],
                    "ids_sha256": [sha256(" ".join(map(names.__getitem__, i.tolist())).encode()).hexdigest() for i in ids],
                    "decoded_sha256": [sha256(bpe.decode(i).encode()).hexdigest() for i in ids],
                }
            )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInPandas(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests are taken where ids and decoded bytes are made, as for op10."""
    from plexweave.llm.byte_bpe import tokenizer

    bound_batches(spark)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = tokenizer()
        names = [str(i) for i in range(len(bpe.size))]
        for b in batches:
            ids = bpe.encode_all(b["text"].tolist())
            yield pd.DataFrame(
                {
                    "doc_id": b["doc_id"],
                    "n_tokens": [len(i) for i in ids],
                    "ids_sha256": [sha256(" ".join(map(names.__getitem__, i.tolist())).encode()).hexdigest() for i in ids],
                    "decoded_sha256": [sha256(bpe.decode(i, bpe.offsets(i))).hexdigest() for i in ids],
                }
            )

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInPandas(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexweave.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plexweave.llm.filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_near_dedup": op2_near_dedup,
    "op3_neighbours": op3_neighbours,
    "op4_language": op4_language,
    "op5_html_text": op5_html_text,
    "op6_mix": op6_mix,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_licences": op8_licences,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_bpe": op10_bpe,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_spelling": op12_spelling,
    "op13_filter_audit": op13_filter_audit,
}
