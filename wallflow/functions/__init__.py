"""Column builders: text cleaning, address predicates, rule-field vocabulary."""
