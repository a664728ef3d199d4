"""Operators that prepare text for language models. Nothing outside this subpackage imports it."""
