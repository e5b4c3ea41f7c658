"""Operators of a training-data pipeline.  Self-contained: the rest of the package never imports it."""
