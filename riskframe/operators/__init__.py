"""DataFrame -> DataFrame operators, grouped as in the inventory."""
