"""Training-data operators over ``documents`` and ``pages``.

Nothing else in the library imports this subpackage.  ``queries`` lists the
registered queries and their oracle SQL.
"""
