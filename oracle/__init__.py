"""DuckDB SQL written independently of the Spark code, for parity checks."""
