"""The operators applied to the driver's parquet tables, and the same results as plain SQL."""
