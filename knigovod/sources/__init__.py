"""Readers for the input tables and writers for the result tables."""
