"""Reports and text contexts composed from the operators."""
