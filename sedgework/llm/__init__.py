"""Operators on texts for language models. Nothing outside this subpackage imports it."""
