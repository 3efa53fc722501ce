"""All registered queries with their DuckDB twins."""

from sealtrail.plans import queries_chain, queries_ingest, queries_policy, queries_search, queries_store

ALL = {
    **queries_chain.QUERIES,
    **queries_search.QUERIES,
    **queries_ingest.QUERIES,
    **queries_policy.QUERIES,
    **queries_store.QUERIES,
}
