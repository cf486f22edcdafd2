"""Readers and writers: PDF folders, golden sets, review sheets, saved runs and the vector store's table."""
