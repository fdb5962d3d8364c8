"""Verdicts for traces that arrive as files: an extension, for which the batch engine is reused whole."""
