"""Training-data operators: one module per operator, one thin contract query each.

Nothing else in the library imports this subpackage.
"""
