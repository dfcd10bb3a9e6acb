"""Named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.checks import ADAPTERS
from . import checks, documents, memory, records, retrieval, streams

_MODULES = (retrieval, memory, records, streams, documents, checks)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in _MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.oracle_sql().items()}


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: greedy packing of ranked turns."""
    return retrieval.pack_greedy(spark, sf_dir)


#: The query that does the work of each adapter of a project's stages; those that call models or search the web have none.
ADAPTER_QUERIES = {
    "artifact": "file_snapshot", "literature_cards": "locate_excerpt", "proposal": "check_proposals", "tabular_experiment": "tabular_threshold", "comparison": "comparison", "evidence_report": "evidence_calc",
    "stale_v5_retrieval": "context_score", "stale_v5_readers": "reader_arms", "stale_v5_judges": "blind_labels", "stale_v5_analysis": "intervals",
}


def adapters(paid: bool = False, network: bool = False) -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The adapters that may run, by name: paid ones and such as use the network only with leave."""
    known = queries()
    return {name: known[q] for name, q in ADAPTER_QUERIES.items() if (paid or not ADAPTERS[name][0]) and (network or not ADAPTERS[name][1])}
