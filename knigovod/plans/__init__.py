"""Operators chained into whole jobs, and the registered queries."""
