"""Registered queries over the test tables, and their SQL twins."""

from tidelog.plans import alignment, arrays, entries, files, jobs, storage
from tidelog.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "alignment", "arrays", "entries", "files", "jobs", "storage"]
