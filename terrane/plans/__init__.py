"""Compositions of operators: assembly, export runs, model training."""
