"""Execution helpers: durable intermediates, round loops, graphs derived from tables."""
