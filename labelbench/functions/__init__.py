"""Column-expression functions (text, casts, math)."""
from . import casts, math, text  # noqa: F401
