"""Which paragraphs op1 compares: short ones, and those of a crowded band value that share no other."""

import random

import pytest
from pyspark.sql import functions as F

from inkscore.llm import paragraph_dedup

rng = random.Random(11)
WORDS = ["".join(rng.choice("abcdefghijkl") for _ in range(4)) for _ in range(2000)]


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def near(base, at):
    return " ".join(rng.choice(WORDS) if k == at else w for k, w in enumerate(base.split()))


def gone(docs, **options):
    return {(r["doc"], r["place"], r["kept_doc_id"]) for r in paragraph_dedup.repeated_paragraphs(docs.withColumn("doc", F.col("doc_id")), **options).collect()}


@pytest.mark.parametrize("crowd", [3, 24])
def test_a_pair_that_shares_one_crowded_band_alone_is_compared(spark, monkeypatch, crowd):
    """All paragraphs share one band value and no two share another: each pair is compared, whatever ``crowd`` is."""

    def one_band(docs, min_words):
        return paragraph_dedup._occurrences(docs, min_words).select(F.lit(16).cast("bigint").alias("key"), "id").distinct()

    monkeypatch.setattr(paragraph_dedup, "_index", one_band)
    bases = [prose(60) for _ in range(4)]
    texts = [base if n == 0 else near(base, 7 * n) for n in range(3) for base in bases] + [prose(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert gone(docs, crowd=crowd) == {(k, 0, k % 4) for k in range(4, 12)}


def test_paragraphs_of_five_words_go_too(spark):
    five, seven, four = prose(5), prose(7), prose(4)
    texts = ["\n".join([five, prose(6)]), "\n".join([seven, four, five]), "\n".join([four, seven.upper()])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert gone(docs) == {(1, 2, 0), (2, 1, 1)}
