"""Quire: a PySpark engine for aligned text corpora.

Versions of one text share a ``(book, chapter, verse)`` coordinate; everything else
(cross references, places, notes, word tokens, itineraries, vectors) hangs off it.
All operators are DataFrame plans; nothing here keeps state on the driver.
"""
