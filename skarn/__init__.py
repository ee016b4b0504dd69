"""A read-only SQL analytics engine over directories of Parquet files, on Spark."""
