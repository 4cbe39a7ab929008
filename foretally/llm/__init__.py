"""Training-data operators: ten numbered operators over `documents` and friends.

Nothing else in the library imports this subpackage.
"""
