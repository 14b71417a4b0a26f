"""Training-data operators: ten components over documents and embeddings.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries when it can be imported.
"""
