"""Where tables come from: directories of Parquet files."""
