"""Relational operators over points, nodes and samples."""
