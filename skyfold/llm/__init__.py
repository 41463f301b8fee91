"""Training-data operators: ten building blocks of a corpus pipeline.

Nothing else in the library imports this subpackage.
"""
