"""Lossless parsers: bytes to node rows.

Every parser works on the bytes of a document read as Latin-1, one character a
byte, so that positions are byte positions and any input can be kept.
"""
