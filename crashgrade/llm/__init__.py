"""Operators for building training corpora; nothing else imports this folder."""
