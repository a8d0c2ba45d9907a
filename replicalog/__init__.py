"""Reconciling and auditing replicated file catalogs with Spark."""
