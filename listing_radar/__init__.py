"""Spark operators for tracking listings found on the web and in public feeds."""
