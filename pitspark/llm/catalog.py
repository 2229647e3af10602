"""Every registered corpus query."""
from pitspark.llm import (byte_bpe, decontaminate, embeddings, hard_negatives, language, licences, materialise, merkle, minhash,  # noqa: F401
                          shards, suffixes, toxicity, url_filters)
from pitspark.llm.registry import ORACLES, QUERIES  # noqa: F401
