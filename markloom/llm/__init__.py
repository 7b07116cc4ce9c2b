"""Training-data operators: one module per operator, one query each in ``queries``."""
