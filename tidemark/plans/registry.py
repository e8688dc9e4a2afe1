"""All queries in one table: name to (Spark function, SQL)."""

from tidemark.plans import behaviour, mapping, revenue, summaries, tables

ALL = {**behaviour.QUERIES, **revenue.QUERIES, **summaries.QUERIES, **mapping.QUERIES, **tables.QUERIES}
