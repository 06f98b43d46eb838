"""Training-data pipeline operators.

Nothing outside this subpackage imports it; it depends only on PySpark and on
general libraries, never on the rest of :mod:`lexigraph`.
"""
