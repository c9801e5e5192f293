"""Column builders: scalar functions as Catalyst expressions."""
