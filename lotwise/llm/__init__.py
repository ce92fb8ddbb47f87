"""Operators of a training-data pipeline: counting, searching, scoring, cleaning and dealing out documents.

Nothing outside this folder imports it. Every operator takes whole tables, reads whole texts, and has a
defined result for NULL, empty and repeated rows; each module says which.
"""
