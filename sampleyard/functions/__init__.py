"""Column functions: names, captions, similarities, rules, fusion and short signals."""
