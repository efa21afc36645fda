"""Training-data pipeline operators: tokens, near-duplicates, quality, HTML, WARC,
conversations, line repeats, media copies and benchmark leaks.

Nothing else in the library imports this subpackage; it can be deleted whole.
"""
