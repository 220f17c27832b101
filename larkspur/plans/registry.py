"""Named queries over the given tables and the SQL that must give the same rows."""

from __future__ import annotations

from . import discovery, episodes, feedback, graph, matching, pools, popularity, ranking, raw, resolve, scoring, sessions, splits, streams, text, vectors  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401

FLAGSHIP = "flagship_recommendations"
