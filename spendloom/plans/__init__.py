"""Presets that map given tables to the model, and the registered queries."""
