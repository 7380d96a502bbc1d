"""Operators for training-data pipelines; nothing else in cairn imports this subpackage."""
