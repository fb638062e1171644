"""Registered queries over projections of the driver's tables."""
