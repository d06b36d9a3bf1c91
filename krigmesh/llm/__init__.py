"""Training-data pipeline operators (text, pages and embeddings at corpus scale).

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
