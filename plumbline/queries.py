"""All queries of the library's own operators and the SQL that checks them."""

from .plans import agent_queries, answer_queries, applier_queries, audio_queries, builder_queries, chain_queries, corpus_queries, data_queries, protocol_queries

MODULES = (agent_queries, answer_queries, applier_queries, audio_queries, builder_queries, chain_queries, corpus_queries, data_queries, protocol_queries)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
