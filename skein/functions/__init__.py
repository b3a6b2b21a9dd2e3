"""Column functions: text, answers, vectors."""
