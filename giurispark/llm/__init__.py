"""Operators for training-data problems on language-model text; nothing outside imports this subpackage."""
