"""tesela: a Spark-native table engine with data-preparation operators.

Nothing in this package imports :mod:`tesela.llm`; that subpackage only builds on the rest.
"""

__version__ = "0.1.0"
