"""All registered queries of the operators."""

from twinlens.llm import q_corpus, q_models, q_native, q_pairs  # noqa: F401
from twinlens.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
