"""Operators of a large-scale training-data pipeline. Nothing else in weftline imports this subpackage."""
