"""The row-local feature plan applied to a stream of answers."""
