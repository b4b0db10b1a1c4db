"""Compare two tables at scale, on Spark."""

from tallybridge.errors import SchemaError, SpecError
from tallybridge.functions.comparators import Tolerance
from tallybridge.plans.reconcile import Reconciliation, count_rows, reconcile

__all__ = ["Reconciliation", "SchemaError", "SpecError", "Tolerance", "count_rows", "reconcile"]
