"""Operators of a training-data pipeline.  Nothing outside this folder imports it, except the entry module's guard."""
