"""The whole analysis as one plan: messages or conversations to a report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate as A
from ..operators import preprocess as P
from ..operators.classify import Classifier, Deterministic, signed
from ..operators.filters import Request, check_selection, conversation_rows, values_keeping_rows
from ..operators.tables import written


@dataclass
class Analysis:
    """Results of an analysis: one row of counters, groups, mapping, questions, themes, report and warnings; all but groups are small reads of written tables."""

    summary: DataFrame
    groups: DataFrame
    assign: DataFrame
    top: DataFrame
    themes: DataFrame
    report: DataFrame
    warnings: DataFrame


def _ordered(rows: DataFrame, label: str, ident: str) -> DataFrame:
    return written(rows, label).orderBy(F.desc("count"), ident)


def analyze(df: DataFrame, row_ix: Column, request: Request, classifier: Classifier | None = None) -> Analysis:
    """Filter, mask, group, classify, count. row_ix is the physical order of rows.

    Texts are read and shuffled once: the groups with their signatures, the distinct messages, are a written
    table with the counts of discarded rows, from which classification, counting, examples and
    summary read the columns that they need. Mapping, top questions and themes are written too.
    """
    request.check()
    check_selection(df, request)
    if c := request.conversation:
        rows = P.contextual_messages(conversation_rows(df, row_ix, request.text_column, c, request.filters), c)
    else:
        rows = P.messages(values_keeping_rows(df, row_ix, request.text_column, request.filters))
    every = written(signed(P.every_group(rows)), "groups")
    summary = P.summary_of(every)
    groups = every.where("status = 'analyzed'").drop("status")
    assign, question, theme = (classifier or Deterministic()).classify(groups)
    assign = written(assign, "assigned")
    A.check_assignment(assign, groups)
    analyzed = summary.first()["analyzed_count"]
    top = _ordered(A.top_questions(assign, question, groups, analyzed, request.top_n), "top", "question_id")
    themes = _ordered(A.themes(assign, question, theme, groups, analyzed, top), "themes", "theme_id")
    A.check_themes(themes, analyzed)
    report = A.report(summary, top, themes, A.executive_summary(top, themes, analyzed))
    warnings = getattr(classifier, "warnings", None)
    if warnings is None:
        warnings = df.sparkSession.createDataFrame([], "code string, n long")
    return Analysis(summary, groups, assign, top, themes, report, warnings)
