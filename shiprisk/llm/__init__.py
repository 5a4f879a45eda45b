"""Training-data operators and the corpus pipeline.

Nothing else in the library imports this subpackage.
"""
