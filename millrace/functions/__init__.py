"""Column functions. Everything here stays inside Catalyst expressions: no Python runs on the executors."""
