"""All queries of the package and their SQL."""

from alarmlens.llm import queries_learned, queries_native

QUERIES = {**queries_native.QUERIES, **queries_learned.QUERIES}
ORACLE = {**queries_native.ORACLE}
