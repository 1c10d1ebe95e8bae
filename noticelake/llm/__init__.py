"""Operators that prepare training text: one module for each, all run as Spark jobs."""
