"""Readers and writers of sequence files and of the text formats between stages."""
