"""Corpus preparation for language-model training; nothing else in seine imports this."""
