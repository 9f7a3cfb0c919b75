"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import bpe, divergence, grammar, html_text, language, line_runs, media, near_dup, packing, quality, simhash, suffix_dups, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {}
    for module in (quality, bpe, media, suffix_dups, packing, near_dup, grammar, html_text, line_runs, language, simhash, whitening, divergence):
        found |= {k: v for k, v in vars(module).items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": line_runs.OP9_SQL, "op13_divergence": divergence.OP13_SQL}
