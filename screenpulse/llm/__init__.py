"""Operators for large training corpora: ten text operators and the plans that chain them.

Nothing outside this subpackage imports it.
"""
