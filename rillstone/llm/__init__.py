"""Operators for training-data pipelines over `documents`-shaped tables.

Nothing outside this subpackage imports it.  Modules: one per operator, plus
`shared` (written tables), `wordhash` (numpy word and shingle hashing),
`components` (connected components) and `queries` (the registered queries).
"""
