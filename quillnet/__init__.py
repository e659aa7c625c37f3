"""Contribution-network analytics as Spark DataFrame jobs."""
