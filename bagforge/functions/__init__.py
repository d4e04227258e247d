"""Column expressions and the chemistry kernel."""
