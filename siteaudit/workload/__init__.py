from siteaudit.workload import (  # noqa: F401
    q_contracts,
    q_elements,
    q_findings,
    q_graph,
    q_rules,
    q_sources,
    q_streaming,
    q_text,
)
from siteaudit.workload.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
