"""A PDF reader in plain Python: objects, structure, content and fonts of one file at a time."""
