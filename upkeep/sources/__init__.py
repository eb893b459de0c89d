"""Sources: the supplied parquet tables, fixture views over them, ingest."""
