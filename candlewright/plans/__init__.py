"""Query registry: fixtures built on the test tables, queries and their SQL twins."""
