"""Sources and sinks: driver tables, fixture corpora, wide/array adapters,
Parquet sinks."""
