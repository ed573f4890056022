"""Conversation analytics on PySpark: one typed ``messages`` table and the questions asked of it."""
