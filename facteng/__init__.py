"""A deductive analytics engine on PySpark: typed relations, rules and queries, evaluated bottom-up as DataFrames."""

from .errors import ProgramError
from .program import Program, Result, V, atom, cmp, con, count_, either, max_, min_, not_, sum_

__all__ = ["Program", "ProgramError", "Result", "V", "atom", "cmp", "con", "count_", "either", "max_", "min_", "not_", "sum_"]
