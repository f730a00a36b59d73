"""Stateful operators, as a batch fold and as a stream with the same results."""
