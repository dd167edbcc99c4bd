"""Preparation of training data for language models. Nothing else in the package imports it."""
