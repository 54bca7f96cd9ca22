"""Retail price intelligence as composable Spark DataFrame jobs."""
