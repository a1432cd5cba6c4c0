"""Preparation of text for language models: one module for each task."""
