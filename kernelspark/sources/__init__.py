"""Sources: parquet tables, text rows, sinks."""
