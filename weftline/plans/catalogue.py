"""All queries of the domain; importing it fills the registry."""

from __future__ import annotations

from weftline.plans import findings, links, moves, nodes, project, scalars, sources, streams, texts, vectors  # noqa: F401
from weftline.plans.registry import QUERIES, SQL

FLAGSHIP = "links_argmax"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
