"""Sources and sinks: parquet tables, CSV upload, JDBC, JSON event streams."""
