"""Planners: level-of-detail selection, traversal, render and prefetch plans, settings."""
