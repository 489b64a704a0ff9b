"""Spark engine for building, auditing and evaluating training and preference data."""
