"""Guarded multi-tenant document retrieval analytics on PySpark."""
