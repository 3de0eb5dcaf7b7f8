"""Operators that a training-text pipeline needs. Nothing outside this subpackage imports it."""
