"""Reading, checking and laying out the input tables."""
