"""Spark-first triage of exception logs."""
