"""Training-data operators: tokenisation, similarity search and joins,
deduplication, scans and classifiers over document tables.

Nothing outside this folder (and ``corpus_pipeline.py``) imports it."""
