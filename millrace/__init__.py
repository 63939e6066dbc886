"""Millrace: page and corpus processing on the Spark DataFrame API."""
