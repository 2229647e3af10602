"""Training-data operators: one module per operator, general helpers in ``words`` and ``graph``."""
