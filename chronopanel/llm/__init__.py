"""Operators for training-data pipelines over text, pages and documents.

Nothing outside this subpackage imports it. `queries` registers one query per operator.
"""
