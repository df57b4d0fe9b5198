"""Training-data pipeline operators: one module per operator, nothing else in the library imports them."""
