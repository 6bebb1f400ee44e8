"""Training-data pipeline operators: thirteen corpus operators and their registered queries.

Nothing else in the library imports this subpackage.  ``queries.py`` holds the registered
queries, ``oracles.py`` the SQL that checks them.
"""
