"""Tessera: document-evidence retrieval and data preparation on Spark."""
