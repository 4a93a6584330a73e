"""Column functions: geometry, text, clocks."""
