"""Column functions: time, numbers, rules, ranges."""
