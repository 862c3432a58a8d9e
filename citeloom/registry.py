"""The library's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import answering_queries, contract_queries, derivation_queries, evaluation_queries, operations_queries, retrieval_queries
from .streaming import work_queue

FLAGSHIP = "rrf_v2"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **retrieval_queries.QUERIES,
    **answering_queries.QUERIES,
    **operations_queries.QUERIES,
    **evaluation_queries.QUERIES,
    **contract_queries.QUERIES,
    **derivation_queries.QUERIES,
    **work_queue.QUERIES,
}

ORACLE_SQL: dict[str, str] = {
    **retrieval_queries.ORACLE_SQL,
    **answering_queries.ORACLE_SQL,
    **operations_queries.ORACLE_SQL,
    **evaluation_queries.ORACLE_SQL,
    **contract_queries.ORACLE_SQL,
    **derivation_queries.ORACLE_SQL,
    # the streams end in the states of the batch folds
    "queue_stream": operations_queries.LIFECYCLE_SQL,
    "alert_stream": f"SELECT event_id, firing FROM ({operations_queries.ALERT_SQL})",
    "hourly_counts": "SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL",
}
