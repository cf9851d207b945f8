"""Name -> query and name -> SQL of the library's own operators."""

from __future__ import annotations

from quern.queries import answers, conversation, logs, profile, relational, retrieval, search, streams, table, text, traces, usage  # noqa: F401
from quern.queries.registry import ORACLES, QUERIES  # noqa: F401
