"""Operators for preparing training data of language models at corpus scale."""
