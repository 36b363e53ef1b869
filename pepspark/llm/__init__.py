"""Operators on training text: tokenizer encoding, evaluation leakage, residue text."""
