"""Column expressions: cleaning, names, rules and display."""
