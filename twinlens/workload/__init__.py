"""All registered queries."""

from twinlens.workload import basic, classic_models, evaluation, files, hidden_heads, language, models, relational, reporting, vectors  # noqa: F401
from twinlens.workload.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
