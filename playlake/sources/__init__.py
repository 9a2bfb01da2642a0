"""Readers and writers of the documents that the engine exchanges."""
