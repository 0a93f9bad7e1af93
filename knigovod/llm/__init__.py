"""Operators for building training data: deduplication, decontamination, filters, mixing, scoring and output.

Nothing else in the library imports this package. Each operator takes DataFrames and returns DataFrames;
`registered` holds the queries that apply them to whole tables."""
