"""Operators that prepare training data for language models. Nothing else in weftline imports this subpackage."""
