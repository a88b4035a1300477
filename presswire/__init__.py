"""presswire: a Spark-native news analytics engine.

Daily article files are loaded into bronze / silver / gold tables, cleaned,
scored and classified with Column expressions, and served by a catalogue of
DataFrame queries.  Sub-packages:

* ``sources``   – table readers, CSV / Parquet sources and sinks, layer DDL
* ``functions`` – Column -> Column building blocks (text, URL, HTML, scores)
* ``operators`` – DataFrame -> DataFrame operators (classify, sentiment,
  lexicon and lemma joins, page extraction, crawl closure, ML models)
* ``plans``     – fixtures, the medallion pipeline and the query catalogue
* ``streaming`` – incremental loads with Structured Streaming
"""

from presswire.session import build_session, checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
