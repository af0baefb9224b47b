"""Column functions and scalar formulas."""
