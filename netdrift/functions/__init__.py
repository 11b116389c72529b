"""Numerical helpers on numpy arrays, without Spark."""
