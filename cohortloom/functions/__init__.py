"""Part of cohortloom."""
