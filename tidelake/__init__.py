"""tidelake: market and ledger data as partitioned Parquet, worked on with Spark."""
