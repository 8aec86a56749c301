"""Tessera: hybrid dense and lexical search over code and text, as Spark plans."""
