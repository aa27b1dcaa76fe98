"""Compositions of operators: the cleaning pipeline and the metric views."""
