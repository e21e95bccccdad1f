"""Every registered query of the library proper and its SQL."""

from slotweave.jobs import extract_jobs, fill_jobs, form_jobs

_MODULES = (extract_jobs, form_jobs, fill_jobs)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
