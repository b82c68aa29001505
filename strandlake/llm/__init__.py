"""Operators on sequences, sketches and texts for training data; nothing outside imports this."""
