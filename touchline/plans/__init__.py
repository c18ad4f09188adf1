"""Queries: operators bound to tables, each with the DuckDB SQL that checks it."""
