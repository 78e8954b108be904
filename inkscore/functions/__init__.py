"""Column builders: every function takes Columns and returns a native Column."""
