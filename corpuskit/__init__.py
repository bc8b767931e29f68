"""corpuskit: build and search text corpora with PySpark.

Everything is DataFrame in, DataFrame out. Sub-packages:

* ``sources``    scans that produce ``documents`` tables (mail, files, web pages)
* ``functions``  column expressions (html text, ids, labels, hashing)
* ``operators``  table operators (dedupe, chunking, embedding, search, prompts, latency)
* ``plans``      whole jobs composed from the operators (ingest, ask)
* ``streaming``  the same work on Structured Streaming
"""

from corpuskit.config import Settings

__all__ = ["Settings"]
__version__ = "0.1.0"
