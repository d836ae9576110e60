"""Readers and writers of corpora, collections, logs and metric files."""
