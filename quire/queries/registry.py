"""All queries of the core, and their SQL."""

from __future__ import annotations

from quire.queries import corpus, ingest, problems

QUERIES = {**corpus.QUERIES, **ingest.QUERIES, **problems.QUERIES}
SQL = {**corpus.SQL, **ingest.SQL, **problems.SQL}
FLAGSHIP = "k3_search_multi"
