"""Operators of a training-data pipeline over documents, pages, vectors and dialogues.

Nothing else in the package imports this subpackage. ``catalog`` registers one
query per operator; ``__spark_entry__`` adds them when the subpackage can be
imported.
"""
