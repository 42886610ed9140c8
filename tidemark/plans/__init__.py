"""End-to-end plans: adapt raw tables, run a sweep, publish results."""
