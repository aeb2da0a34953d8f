"""Operators of a training-data pipeline over web documents; nothing outside this subpackage imports it."""
