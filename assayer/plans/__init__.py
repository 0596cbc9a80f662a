"""Whole pipelines: prepare a dataset, ask a question of it."""
