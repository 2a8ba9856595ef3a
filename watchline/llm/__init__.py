"""Operators for preparing language-model training text; optional, imported by nothing else here."""
