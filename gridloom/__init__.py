"""gridloom: a PySpark-native engine for the tables, images and text blocks found in documents."""

__version__ = "0.1.0"
