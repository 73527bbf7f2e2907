"""Operators for preparing large text and record collections. Nothing else in the library imports this subpackage."""
