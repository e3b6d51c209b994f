"""Classifiers map records to questions and themes; they never produce numbers."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import numbered as ranges

#: Titles of what no signature covers.
OTHER_QUESTION, OTHER_THEME, OTHER_ID = "Sınıflandırılamayan kısa mesajlar", "Diğer", "t-diger"


class Classifier(Protocol):
    identifier: str

    def classify(self, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """assign (record_id, question_id), question (question_id, canonical_question, theme_id, position), theme (theme_id, name)."""
        ...


def signed(groups: DataFrame) -> DataFrame:
    """groups with the signature of each, computed unless it is there already."""
    return groups if "signature" in groups.columns else groups.withColumn("signature", T.signature(F.col("key")))


def token_corpus(groups: DataFrame) -> DataFrame:
    """(token, freq): how many messages have the token in their signature."""
    return signed(groups).select(F.explode("signature").alias("token"), "count").groupBy("token").agg(F.sum("count").alias("freq"))


def signature_buckets(groups: DataFrame) -> DataFrame:
    """(signature, count, n_records, text): groups by signature; the message seen most speaks for a bucket, of equals the greatest id."""
    return signed(groups).groupBy("signature").agg(F.sum("count").alias("count"), F.count("*").alias("n_records"), F.max_by("redacted_text", F.struct("count", "record_id")).alias("text"))


class Deterministic:
    """Signatures as questions, the signature's most frequent token in the corpus as theme."""

    identifier = "deterministic-proxy/v1"

    def questions(self, groups: DataFrame) -> DataFrame:
        # A title needs no more than the head of a text, so none is shuffled whole.
        buckets = signature_buckets(groups.withColumn("redacted_text", T.heading(F.col("redacted_text"))))
        # Numbers run over all questions, by falling count, in ranges of that order: most questions have the same few counts.
        none = F.size("signature") == 0
        numbered = ranges(buckets, [none, F.desc("count"), F.col("signature")], "position").withColumn("position", F.col("position").cast("int"))
        words = numbered.select("position", F.explode("signature").alias("token")).join(token_corpus(groups), "token")
        theme = words.groupBy("position").agg(F.max_by("token", F.struct("freq", "token")).alias("token"))
        return numbered.join(theme, "position", "left").select(
            "signature",
            "position",
            "count",
            F.concat(F.lit("q"), F.col("position").cast("string")).alias("question_id"),
            F.when(none, F.lit(OTHER_QUESTION)).otherwise(F.col("text")).alias("canonical_question"),
            F.when(none, F.lit(OTHER_ID)).otherwise(F.concat(F.lit("t-"), F.col("token"))).alias("theme_id"),
            F.when(none, F.lit(OTHER_THEME)).otherwise(T.capitalize(F.col("token"))).alias("theme_name"),
        )

    def classify(self, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        # A row for each question, read by every count that follows.
        q = self.questions(groups).persist()
        assign = signed(groups).select("record_id", "signature").join(q.select("signature", "question_id"), "signature").select("record_id", "question_id")
        theme = q.groupBy("theme_id").agg(F.min_by("theme_name", "position").alias("name"))
        return assign, q.select("question_id", "canonical_question", "theme_id", "position"), theme
