"""Operators that turn raw documents and pages into training data. Nothing else in the library imports them."""
