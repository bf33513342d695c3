"""Operators over corpora: association, full text, matrices, clusters."""
