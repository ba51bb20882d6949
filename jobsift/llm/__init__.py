"""Training-data operators: de-duplication, filtering, tokenising and scoring of text corpora.

Nothing outside this package imports it; ``queries.py`` lists its registered queries.
"""
