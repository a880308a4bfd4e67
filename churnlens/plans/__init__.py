"""Query catalogue: Spark plans and their independent DuckDB SQL oracles."""
