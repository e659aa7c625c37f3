"""All registered queries of the text operators."""

from quillnet.llm import (  # noqa: F401
    centroid_clusters,
    chat_format,
    decontamination,
    embedding_dedup,
    language_id,
    lexical_search,
    ngram_join,
    quality,
    secret_scan,
    sentence_pieces,
    source_mix,
    url_filter,
    warc,
)
from quillnet.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
