"""Registration of queries over the index beside their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..mesh import SQL as MESH
from ..mesh import Mesh, open_mesh

us = F.unix_micros
Query = Callable[[SparkSession, str], DataFrame]


def registry() -> tuple[dict[str, Query], dict[str, str], Callable[..., None]]:
    """(queries, sql, add). add(name, operator on the index, SQL over the same projection or None)."""
    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}

    def add(name: str, run: Callable[[Mesh], DataFrame], text: str | None, recursive: bool = False) -> None:
        queries[name] = lambda spark, d: run(open_mesh(spark, d))
        if text is not None:
            sql[name] = f"WITH {'RECURSIVE ' * recursive}{MESH}{'' if text.lstrip().startswith('SELECT') else ','}\n{text}"

    return queries, sql, add
