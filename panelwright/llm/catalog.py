"""Registered queries of the text operators, with SQL counterparts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelwright.llm import archive, chat, decontaminate, language, lines, manifest, mixing, pii, quality, repair, secret_scan, simhash, stable_ann
from panelwright.llm.common import table

# The production mix: domains by source, weights by domain and language; unnamed sources have weight 1.
MIX = mixing.Mix(
    weights={"domain": {"web": 5, "books": 3, "reference": 2, "forum": 2}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}},
    domains={f"src{i}": ("web", "books", "reference", "forum")[i // 5] for i in range(20)},
    budget_percent=100,
    max_epochs=3,
    seed=17,
)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": lambda spark, sf_dir: secret_scan.result(_docs(spark, sf_dir)),
    "op2_mixing": lambda spark, sf_dir: mixing.mixed(_docs(spark, sf_dir), MIX, ["doc_id", "lang", "source"]),
    "op3_decontaminate": lambda spark, sf_dir: decontaminate.contaminated(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark")),
    "op4_language": lambda spark, sf_dir: language.result(_docs(spark, sf_dir)),
    "op5_quality": lambda spark, sf_dir: quality.verdicts(_docs(spark, sf_dir)),
    "op6_line_dedup": lambda spark, sf_dir: lines.report(_docs(spark, sf_dir)),
    "op7_archive": lambda spark, sf_dir: archive.result(table(spark, sf_dir, "pages")),
    "op8_chat": lambda spark, sf_dir: chat.result(table(spark, sf_dir, "conversations")),
    "op9_pii": lambda spark, sf_dir: pii.result(_docs(spark, sf_dir)),
    "op10_simhash": lambda spark, sf_dir: simhash.result(_docs(spark, sf_dir)),
    "op11_repair": lambda spark, sf_dir: repair.result(table(spark, sf_dir, "conversations")),
    "op12_manifest": lambda spark, sf_dir: manifest.result(_docs(spark, sf_dir)),
    "op13_neighbours": lambda spark, sf_dir: stable_ann.result(table(spark, sf_dir, "embeddings")),
}

ORACLE: dict[str, str] = {
    "op2_mixing": mixing.oracle_sql(MIX),
    "op5_quality": quality.ORACLE_SQL,
    "op6_line_dedup": lines.ORACLE_SQL,
    "op7_archive": archive.ORACLE_SQL,
    "op8_chat": chat.oracle_sql(),
    "op11_repair": repair.ORACLE_SQL,
    "op12_manifest": manifest.ORACLE_SQL,
}
