"""Bags, keyed bags and their change feeds on Spark."""
