"""Operators for building language-model training sets. Nothing outside this subpackage imports it."""
