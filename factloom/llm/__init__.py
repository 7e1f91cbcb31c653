"""Training-data operators: one module per operator plus their registered queries.

Nothing else in the library imports this subpackage; it imports only general
helpers (tables, checkpoint folder) from the library.
"""
