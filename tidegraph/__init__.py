"""Incremental analytics over evolving directed multigraphs on Spark."""
