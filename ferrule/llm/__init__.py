"""Operators on training texts. Nothing outside this subpackage imports it."""
