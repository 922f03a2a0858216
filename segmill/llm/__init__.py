"""Operators for building text training sets; nothing else in the package imports this subpackage."""
