"""Queries over the driver's tables and the SQL that must agree with them."""

from . import domain, more, series, study

QUERIES = series.QUERIES | domain.QUERIES | more.QUERIES | study.QUERIES
SQL = series.SQL | domain.SQL | more.SQL | study.SQL
