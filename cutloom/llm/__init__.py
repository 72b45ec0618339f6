"""Operators for preparing language-model training data.

Nothing else in ``cutloom`` imports this subpackage. Each module holds one operator with its
general interface; ``queries`` binds the fixed per-operator queries the driver runs.
"""
