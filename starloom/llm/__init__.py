"""Training-data operators: ten stages for text corpora at cluster scale.

Nothing outside this subpackage imports it.  Each operator module holds a
general interface; ``queries.py`` derives the thin ``opN_*`` queries.
"""
