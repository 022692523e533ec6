"""Column builders for one curve and the small dense solvers used on the driver."""
