"""A PySpark library for credit applications: features, balancing, models, reports, scoring."""
