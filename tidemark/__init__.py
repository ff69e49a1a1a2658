"""Tidemark: versioned, transactional Parquet tables on plain PySpark."""
