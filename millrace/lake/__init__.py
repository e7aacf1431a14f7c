"""Versioned tables on plain Parquet: immutable files, and a manifest for each version."""

from millrace.lake.table import LakeTable

__all__ = ["LakeTable"]
