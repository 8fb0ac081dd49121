"""Operators for training-data pipelines. Nothing else in meander imports this."""
