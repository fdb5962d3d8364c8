"""failscope: failure analytics for AI-agent execution traces on Spark."""

__version__ = "0.2.0"
