"""The query catalogue: each operator on the driver's tables, with its SQL."""
