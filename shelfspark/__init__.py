"""Catalogue analytics, near-duplicate detection and record linkage as Spark jobs."""
