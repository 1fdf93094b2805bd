"""Readers and writers: driver tables, lenient CSV, file listings, keyed registry."""
