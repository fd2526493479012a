"""All queries of the core by name, and their SQL."""

from __future__ import annotations

from corpusmill.plans import corpus

QUERIES = {**corpus.QUERIES}
SQL = {**corpus.SQL}
