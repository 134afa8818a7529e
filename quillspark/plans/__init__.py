"""Options and whole-document plans."""
