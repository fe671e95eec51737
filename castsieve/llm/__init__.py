"""Operators for preparing text for language models.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
