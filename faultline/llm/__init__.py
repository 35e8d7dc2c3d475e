"""Corpus-preparation operators; see ``queries`` for the registered queries."""
