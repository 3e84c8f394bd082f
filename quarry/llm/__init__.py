"""Operators of a training-data pipeline.

Nothing else in the library imports this package: its queries and SQL are in
``quarry.llm.queries`` and are added by ``__spark_entry__.py`` if it is there.
"""
