"""All registered queries: importing the query modules fills the registry."""

from scriptorium.plans import (  # noqa: F401
    clean_queries,
    link_queries,
    report_queries,
    resolve_queries,
    retrieve_queries,
    segment_queries,
    source_queries,
)
from scriptorium.plans.registry import QUERIES, SQL  # noqa: F401
