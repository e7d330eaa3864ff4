"""Registered queries and their SQL, by module."""

from passageworks.plans import corpus, general, reports, retrieval

MODULES = [corpus, retrieval, reports, general]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
