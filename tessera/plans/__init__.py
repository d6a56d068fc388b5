"""Registered queries over the standard tables, with equivalent DuckDB SQL."""
