"""Texts told apart as prose, list, table, junk or code by rules learned from labelled ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.rules import Rule, case_sql, induce
from strandloom.llm.textstats import FEATURES, text_features
from strandloom.session import pick

#: The classes in the order of their rules; what no rule holds for is of the last.
KINDS = ["junk", "table", "list", "prose", "code"]
#: At most so many labelled texts are learned from, those with the lowest hash of their id.
MOST_LABELLED = 20_000
#: Shorter texts are neither learned from nor classified.
LEAST_CHARS = 200


def agreed_labels(labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """Rows (doc_id, kind): the kind that most labels of an id give, for at most ``most`` ids; null and unknown kinds and ties don't count."""
    rows = pick(labels, doc_id="doc_id", kind="kind").where(F.col("doc_id").isNotNull() & F.col("kind").isin(KINDS))
    votes = rows.groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    ranked = votes.groupBy("doc_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("n", "kind")))).alias("v"))  # at most one of each kind
    clear = ranked.where((F.size("v") == 1) | (F.get("v", F.lit(0))["n"] > F.get("v", F.lit(1))["n"]))
    return clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", F.col("v")[0]["kind"].alias("kind"))


def learn_kinds(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> list[Rule]:
    """Rules from the labelled texts; none if nothing is labelled.

    One scan of the texts, which are joined with the labels (at most ``most`` rows, so they may be broadcast); what comes to the driver is at most ``most``
    rows of figures. Rules once learned can be kept and given to ``text_kinds``, which then reads the corpus once.
    """
    known = agreed_labels(labels, most)
    texts = pick(docs, doc_id="doc_id", text="text").where(F.length("text") >= LEAST_CHARS).join(F.broadcast(known), "doc_id")
    table = text_features(texts, ["doc_id", "kind"]).toPandas().sort_values("doc_id", kind="stable")
    if not len(table):
        return []
    return induce(table[FEATURES].to_numpy(), table["kind"].to_numpy(object), FEATURES, KINDS)


def text_kinds(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows (doc_id, kind): the kind of each text of at least ``LEAST_CHARS`` characters, by the rules as one CASE expression.

    Null, empty and shorter texts have no row; repeated rows have one each.
    """
    texts = pick(docs, doc_id="doc_id", text="text").where(F.length("text") >= LEAST_CHARS)
    return text_features(texts, ["doc_id"]).select("doc_id", F.expr(case_sql(rules, KINDS[-1])).alias("kind"))


def describe_texts(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Rows (doc_id, n_lines, mean_words, mean_word_length, symbol_share, end_punct_share, common_share, distinct_share, kind): figures of every text's body, shares of characters
    (of words where words are counted); kind is null for texts shorter than ``LEAST_CHARS``. Null, empty and blank texts have zeros."""
    texts = pick(docs, doc_id="doc_id", text="text").select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    kind = F.when(F.col("size") >= LEAST_CHARS, F.expr(case_sql(rules, KINDS[-1])))
    return text_features(texts, ["doc_id", "size"], described=True).select(
        "doc_id", F.col("lines").cast("bigint").alias("n_lines"), "mean_words", F.col("word_length").alias("mean_word_length"), F.col("signs").alias("symbol_share"), F.col("stop_lines").alias("end_punct_share"),
        F.col("common").alias("common_share"), F.col("distinct_words").alias("distinct_share"), kind.alias("kind"),
    )
