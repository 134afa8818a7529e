"""Token, group, state, table, field and container operators."""
