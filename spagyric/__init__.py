"""spagyric: extraction of typed records from scientific documents, as DataFrame plans."""

__version__ = "0.1.0"
