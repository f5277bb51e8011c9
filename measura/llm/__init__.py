"""Operators that prepare text for training: repair, language, names, tokens, packing, content."""
