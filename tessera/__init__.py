"""A PySpark-native engine for block-structured data in Parquet."""
