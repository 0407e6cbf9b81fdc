"""Marketplace order analytics as Spark DataFrame jobs."""
