"""Column expressions; nothing in here reads data or starts a job."""
