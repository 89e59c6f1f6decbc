"""Byte ranges, request logs, range caches and catalogs."""
