"""quillspark: document analytics on Spark.

A corpus of Markdown sources is parsed once into a flattened, interval-encoded
node array per document; every other operator is a DataFrame or SQL expression
over that array.
"""

__version__ = "0.1.0"
