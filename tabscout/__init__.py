"""Data-readiness checks for labelled tables, as Spark DataFrame operations."""

from tabscout.plans.audit import AuditResult, audit
from tabscout.table import LabelledTable

__all__ = ["AuditResult", "LabelledTable", "audit"]
