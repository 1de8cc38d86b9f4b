"""All queries of this package; importing it registers them."""

from sharetide.llm import (  # noqa: F401
    common,
    op01_packing,
    op02_jaccard,
    op03_substring,
    op04_chat,
    op05_embeddings,
    op06_lm,
    op07_bpe,
    op08_langid,
    op09_quality,
    op10_suffix,
    op11_warc,
    op12_variants,
    op13_alignment,
)

QUERIES, ORACLES = common.QUERIES, common.ORACLES
