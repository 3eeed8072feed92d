"""Operations of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  ``kgflow.llm.registry`` lists its
queries and, where SQL can express them, their DuckDB equivalents.
"""
