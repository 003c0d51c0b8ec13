"""Vocarium: word spaces by counting, on Spark: corpus to sparse counts to vectors to measured claims."""
