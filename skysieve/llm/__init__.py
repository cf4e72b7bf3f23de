"""Operators for large training-data pipelines.

Nothing else in the package imports this subpackage, and it imports nothing
from the rest of the package.
"""
