"""Logical plans built from the operators."""
