"""Sources and sinks: Parquet tables, typed CSV scan, result tables, test fixtures."""
