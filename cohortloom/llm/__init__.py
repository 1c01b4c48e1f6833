"""Operators for training data. Nothing else in cohortloom imports this subpackage."""
