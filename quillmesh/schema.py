"""Vocabulary of the graph index."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The node, edge and change types and the ladders of severity of the index format.
NODE_TYPES = ("atomic_process", "composite_process", "entity")
EDGE_TYPES = ("annotates", "composes", "constrains", "consumes", "delegates_to", "depends_on", "documents", "produces", "supersedes", "validates")
OWN = ("VERIFIED", "DESC_UPDATED", "CONTENT_UPDATED", "RENAMED", "NOT_FOUND")
LINK = ("VERIFIED", "LINKED_STALE", "BROKEN_LINK")
CODE_CHANGES = ("CONTENT_ONLY", "CONTENT_AND_DESC", "BECAME_CONTENT_UPDATED")
CODE_OR_DESC_CHANGES = (*CODE_CHANGES, "DESC_ONLY")
CONTENT_EVENTS = ("INITIAL", "CONTENT_ONLY", "DESC_ONLY", "CONTENT_AND_DESC")
STATUS_EVENTS = ("BECAME_CONTENT_UPDATED", "BECAME_DESC_UPDATED", "BECAME_NOT_FOUND", "BECAME_RENAMED", "BECAME_LINKED_STALE", "BECAME_BROKEN_LINK", "LINK_BECAME_VERIFIED", "BECAME_VERIFIED")
LINK_EVENTS = ("LINK_ADDED", "LINK_REMOVED")
VERIFY_EVENTS = ("AGENT_VERIFIED", "MANUAL_VERIFIED")
DOC_SOURCES = ("docjson", "doc_scanner", "json_doc_scanner")
LONG_SECTION = 2000
KEPT_HISTORY = 100
TYPE_ALIASES = {"function": "atomic_process", "module": "composite_process"}


def severity(status: str | Column, ladder: tuple[str, ...]) -> Column:
    """The place of a status on its ladder; unknown and null statuses count as the lowest."""
    c = status if isinstance(status, Column) else F.col(status)
    return F.coalesce(F.element_at(F.create_map(*[x for i, s in enumerate(ladder) for x in (F.lit(s), F.lit(i))]), F.coalesce(c, F.lit(""))), F.lit(0))


def status_of(level: Column, ladder: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in ladder]), level + 1)
