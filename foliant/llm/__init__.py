"""Operators that prepare text corpora for language models.

Nothing outside this subpackage imports it; deleting it (and ``tests/llm``)
leaves the rest of the engine working.
"""
