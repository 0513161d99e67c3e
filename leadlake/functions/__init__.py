"""SQL expressions of the rules: word lists, keys, names, emails, classes."""
