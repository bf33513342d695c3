"""Corpora that grow from streams."""
