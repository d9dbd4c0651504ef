"""Operators for preparing training data: ten self-contained modules.

Nothing outside this subpackage imports it. Shared helpers for texts in Arrow batches are in
``textops``; every operator module states its method, its result and its edge cases.
"""
