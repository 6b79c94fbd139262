"""Registered queries of the media operators."""
