"""Column functions: answers, ids, numbers, text and integer sequences."""
