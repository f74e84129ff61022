"""Part of lorekeep, document-corpus retrieval analytics on PySpark."""
