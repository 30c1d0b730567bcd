"""Curation and evaluation of recorded multi-speaker discussions, as Spark jobs."""
