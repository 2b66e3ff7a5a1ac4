"""Supervisory analytics over security-operations data, and corpus operators, on Spark."""
