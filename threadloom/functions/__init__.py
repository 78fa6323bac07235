"""Column functions: text cleaning, redaction, tokens and commands."""
