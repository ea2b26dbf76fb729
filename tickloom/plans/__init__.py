"""Whole plans that combine operators."""
