"""sampleyard: analytics over large libraries of audio samples, written as Spark plans."""

__version__ = "0.1.0"
