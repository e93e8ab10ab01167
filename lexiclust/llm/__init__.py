"""Training-data operators: packing, sharding, extraction, archives, filtering
and deduplication of text corpora.  Nothing else in the library imports this
subpackage."""
