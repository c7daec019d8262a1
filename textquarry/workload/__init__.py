"""The registered queries: every operator over the given tables, with its SQL.

``views`` derives file trees, chunks and vectors from the given tables with SQL
that Spark and DuckDB both run; the ``q_`` modules register one query per
operator next to the SQL that must give the same rows.
"""
