"""loomline: data processing on Spark DataFrames.

``operators`` hold joins, folds and deduplication, ``functions`` column
expressions, ``sources`` readers, ``plans`` the registered queries and
``streaming`` stateful streams.  The subpackage ``llm`` is optional; nothing
outside it imports it.
"""
