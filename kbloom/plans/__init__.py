"""Registered queries, each with the DuckDB SQL it is checked against."""
