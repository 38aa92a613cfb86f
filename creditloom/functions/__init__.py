"""Column-to-Column building blocks. Nothing here starts a job."""
