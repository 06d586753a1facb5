"""Every registered query of the subpackage; importing the operators registers them."""

from __future__ import annotations

from . import alignment, conversation_trie, exact_dedup, licenses, mixing, ngram_join, packing, quality_classifier, quality_rules, secrets, substring_dedup, token_files, warc  # noqa: F401
from .common import QUERIES, SQL  # noqa: F401
