"""Operators for training-data pipelines; nothing else in vitalframe imports this subpackage."""
