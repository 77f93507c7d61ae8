"""All registered queries (import side effect registers them)."""

from dyad.plans import q_dataset, q_eval, q_graph, q_json, q_learn, q_matrix, q_regression, q_resolve, q_text  # noqa: F401
from dyad.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
