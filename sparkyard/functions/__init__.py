"""Column functions: no UDFs, every one a Catalyst expression."""
