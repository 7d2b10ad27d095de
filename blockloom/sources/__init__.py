"""Readers, table sinks and the derived test tables."""
