"""A store of analysis documents as Parquet tables, addressed by the documents' content."""
