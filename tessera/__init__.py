"""SQL text and query plans as DataFrames, with a catalogue of Spark queries."""

__version__ = "0.2"
