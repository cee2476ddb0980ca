"""Training-data operators: ten corpus stages and their thin queries.

Nothing else in the library imports this subpackage; ``queries`` holds the registered queries.
"""
