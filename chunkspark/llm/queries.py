"""The registered queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.layout import spread
from .common import session_ready, table
from .graph_search import nearest_of_hundredths
from .lengths import length_report
from .linedup import SQL as LINE_SQL
from .linedup import line_report
from .mixing import mix_sources
from .neardup import SQL as NEAR_SQL
from .neardup import near_duplicates
from .pieces import piece_report
from .ppm import language_scores
from .rules import SQL as RULES_SQL
from .rules import quality_rules
from .secrets import secret_report, sql as secret_sql
from .suffixes import SQL as REPEAT_SQL
from .suffixes import repeat_report

#: A small table is dealt out to all cores by its key; a large one is read as it lies.
KEYS = {"documents": "doc_id", "embeddings": "vec_id"}
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def over(name: str, source: str, sql: str | None = None):
    def add(build: Callable[[DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            session_ready(spark)
            return build(spread(table(spark, sf_dir, source), KEYS[source]))

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return build

    return add


over("op1_mix_sources", "documents")(lambda docs: mix_sources(docs).drop("source"))
over("op2_nearest_neighbours", "embeddings")(nearest_of_hundredths)
over("op3_piece_encoding", "documents")(piece_report)
over("op4_language_scores", "documents")(language_scores)
over("op5_quality_rules", "documents", RULES_SQL)(quality_rules)
over("op6_length_histogram", "documents")(length_report)
over("op7_repeated_strings", "documents", REPEAT_SQL)(repeat_report)
over("op8_near_duplicates", "documents", NEAR_SQL)(lambda docs: near_duplicates(docs, similarity=0.85))
over("op9_line_dedup", "documents", LINE_SQL)(line_report)
over("op10_secret_scan", "documents", secret_sql())(secret_report)
