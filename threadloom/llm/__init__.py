"""Training-data operators: each module is one operator with its own general interface.

Nothing else in the package imports this subpackage; it can be deleted without effect on the rest.
"""
