"""Operators for preparing training text at corpus scale.

Nothing outside this subpackage imports it; ``queries`` registers its queries.
"""
