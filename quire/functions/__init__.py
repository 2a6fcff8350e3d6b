"""Column functions: geometry, names, encodings. All are built-in expressions."""
