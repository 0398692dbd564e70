"""Training-data operators: the ten dealt operators and their queries.

Nothing outside this folder imports it, and it imports nothing of the rest of the package.
"""
