"""Documents and files: JSON, Parquet with Zstd, and the compact binary format."""
