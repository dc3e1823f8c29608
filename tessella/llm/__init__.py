"""Operators for training-data pipelines at corpus scale.

Nothing else in the library imports this subpackage; its queries reach the
driver only through ``registry``.
"""
