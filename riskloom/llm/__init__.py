"""Operators for large-scale training-data work. Nothing else in riskloom imports this subpackage."""
