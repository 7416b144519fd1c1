"""Operators for preparing training text at cluster scale.

Nothing outside this subpackage imports it; the queries are in :mod:`tidewater.llm.registry`.
"""
