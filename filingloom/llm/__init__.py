"""Training-data operators over documents and pages.

Nothing outside this subpackage imports it.  ``queries.queries()`` lists the
registered queries and ``queries.oracle_sql()`` their SQL counterparts.
"""
