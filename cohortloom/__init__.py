"""cohortloom: cohort studies over relational event data and free text, on Spark."""
