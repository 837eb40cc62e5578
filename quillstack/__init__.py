"""Quillstack: DataFrame-native search, de-duplication, graph, timeline and integrity operators."""
