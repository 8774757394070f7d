"""Column expressions only: nothing here starts a job."""
