"""Lexicon scores from a table of any size, and entity overlap with a gazetteer."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens as tk
from ..functions.lexicons import valence_struct
from ..session import materialise
from .joins import lookup_join


def _word_scores(docs: DataFrame, table: DataFrame, key: str, text: str) -> DataFrame:
    words = docs.select(key, F.explode_outer(tk.lowered_words(F.col(text))).alias("word"))
    return lookup_join(
        words, table, "word", "left", spread_by=[key]
    )


def polarity_scores(docs: DataFrame, table: DataFrame, key: str = "student_id", text: str = "text") -> DataFrame:
    """(key, polarity, subjectivity): means over the known words, 0 without any."""
    return (
        _word_scores(docs, table, key, text)
        .groupBy(key)
        .agg(
            F.coalesce(F.avg("polarity"), F.lit(0.0)).alias("polarity"),
            F.coalesce(F.avg("subjectivity"), F.lit(0.0)).alias("subjectivity"),
        )
    )


def valence_scores(docs: DataFrame, table: DataFrame, key: str = "student_id", text: str = "text") -> DataFrame:
    """(key, scores struct) from the valence of the known words."""
    v = F.col("valence")
    sums = (
        _word_scores(docs, table, key, text)
        .groupBy(key)
        .agg(
            F.coalesce(F.sum(F.when(v > 0, v + 1.0)), F.lit(0.0)).alias("p"),
            F.coalesce(F.sum(F.when(v < 0, 1.0 - v)), F.lit(0.0)).alias("n"),
            F.count_if(F.col("word").isNotNull() & (F.coalesce(v, F.lit(0.0)) == 0)).cast("double").alias("z"),
            F.coalesce(F.sum("valence"), F.lit(0.0)).alias("x"),
        )
    )
    return sums.select(key, valence_struct(F.col("p"), F.col("n"), F.col("z"), F.col("x")).alias("scores"))


def phrases(text: str, lengths: list[int]):
    """Distinct lower-cased n-grams of the tokens, of the given lengths."""
    token_array = tk.tokens(F.lower(text))
    return F.array_distinct(F.flatten(F.array(*[tk.ngrams(token_array, n) for n in lengths])))


def prompt_entities(prompts: DataFrame, gazetteer: DataFrame, text: str = "prompt_text") -> DataFrame:
    """(prompt_id, entities): array of the (phrase, label) pairs found in each passage.

    Names may be of any length: the lengths that occur in the gazetteer, a few numbers, are asked for first.
    """
    names = gazetteer.select("phrase", "label").distinct()
    sizes = names.where(F.col("phrase") != "").select(F.size(F.split("phrase", " ")).alias("n")).distinct()
    lengths = sorted(r["n"] for r in sizes.toLocalIterator()) or [1]
    spelled = prompts.select("prompt_id", F.explode(phrases(text, lengths)).alias("phrase"))
    found = lookup_join(spelled, names, "phrase", "inner", spread_by="prompt_id")
    return found.groupBy("prompt_id").agg(F.collect_list(F.struct("phrase", "label")).alias("entities"))


def trie(names: Iterable[tuple[str, str]]) -> dict:
    """Phrases as paths of tokens; the node that a phrase ends at holds its labels under the empty token."""
    root: dict = {}
    for phrase, label in names:
        node = root
        for token in phrase.split(" "):
            node = node.setdefault(token, {})
        node.setdefault("", []).append(label)
    return root


def spoken(root: dict, tokens: Sequence[str]) -> Counter:
    """Number of different names by label among the tokens: from each token on, as far as the trie goes."""
    found: dict[int, list[str]] = {}
    for at, token in enumerate(tokens):
        node, to = root.get(token), at + 1
        while node is not None:
            if "" in node:
                found[id(node)] = node[""]
            node, to = node.get(tokens[to]) if to < len(tokens) else None, to + 1
    return Counter(label for labels in found.values() for label in labels)


def entity_overlap(
    summaries: DataFrame,
    prompts: DataFrame,
    gazetteer: DataFrame,
    key: str = "student_id",
    text: str = "text",
    answers_per_trie: int = 50_000,
) -> DataFrame:
    """(key, label, n_common): entities of the passage that the answer names too.

    An entity counts only if the passage has it, so the gazetteer is joined to the passages alone. A passage's names reach
    its answers as one row ahead of them, by a sort, and become a trie that each answer's tokens walk once: what an answer
    costs does not depend on how many names there are. A passage of more than ``answers_per_trie`` answers is split into
    shares, each with its own copy of the names.
    """
    entities = materialise(prompt_entities(prompts, gazetteer), "entities")
    answers = summaries.select(key, "prompt_id", tk.tokens(F.lower(text)).alias("tokens"))
    loads = answers.groupBy("prompt_id").agg(F.ceil(F.count("*") / answers_per_trie).cast("int").alias("shares"))
    loads = materialise(loads.where("shares > 1"), "entity-shares")
    answers = lookup_join(answers, loads, "prompt_id", "left", spread_by=key)
    shares = F.coalesce(F.col("shares"), F.lit(1))
    named = lookup_join(entities, loads, "prompt_id", "left").select("prompt_id", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"), "entities")
    rows = answers.select("prompt_id", F.pmod(F.xxhash64(key), shares).cast("int").alias("share"), key, "tokens").join(
        named.select("prompt_id").distinct(), "prompt_id", "left_semi"
    )
    both = named.select("prompt_id", "share", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema[key].dataType).alias(key), F.lit(None).cast("array<string>").alias("tokens"), "entities").unionByName(
        rows.select("prompt_id", "share", F.lit(1).alias("kind"), key, "tokens", F.lit(None).cast(named.schema["entities"].dataType).alias("entities"))
    )
    ordered = both.repartition("prompt_id", "share").sortWithinPartitions("prompt_id", "share", "kind")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict = {}
        for batch in batches:
            at, labels, numbers = [], [], []
            for n, (kind, tokens, names) in enumerate(zip(*(batch.column(k).to_pylist() for k in (2, 4, 5)), strict=True)):
                if kind == 0:
                    root = trie((e["phrase"], e["label"]) for e in names)
                    continue
                for label, number in spoken(root, tokens or []).items():
                    at.append(n)
                    labels.append(label)
                    numbers.append(number)
            columns = [batch.column(3).take(pa.array(at, pa.int64())), pa.array(labels, pa.string()), pa.array(numbers, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [key, "label", "n_common"])

    made = ordered.mapInArrow(walk, rows.select(key).schema.add("label", "string").add("n_common", "long"))
    return made.groupBy(key, "label").agg(F.sum("n_common").alias("n_common"))
