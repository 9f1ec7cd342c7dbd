"""Key-phrase mining and boolean keyword policies over large document tables, on Spark."""

__version__ = "0.1.0"
