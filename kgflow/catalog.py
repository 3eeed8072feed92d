"""Every registered query over the driver's tables, with SQL that says the same."""

from kgflow.queries import joins, merge, misc, more, text

QUERIES: dict = {}
SQL: dict = {}
for _module in (joins, merge, text, misc, more):
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
