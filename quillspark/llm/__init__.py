"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``queries.py`` registers its
queries and SQL for the driver contract.
"""
