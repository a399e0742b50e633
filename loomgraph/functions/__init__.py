"""Column expressions and driver-side helpers that operators are composed of."""
