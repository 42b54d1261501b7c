"""sdlweave: schema documents as data, on Spark DataFrames.

Sub-packages: ``functions`` (column expressions), ``sdl`` (lexer, parser and the
table functions built on them), ``sources`` (scans and nested-record shredding),
``operators`` (relational operators over document collections), ``streaming``
(incremental forms), ``generation`` (search-to-operation pipeline) and ``plans``
(the registered queries).  ``llm`` is optional: nothing else imports it.
"""
