"""The queries of this subpackage and, where SQL expresses them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyforge.llm import binary, centroids, chat, fingerprints, jaccard, mixing, packing, pareto, perplexity, pii, quality, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": fingerprints.op1_fingerprints,
    "op2_quality": quality.op2_quality,
    "op3_binary": binary.op3_binary,
    "op4_pii": pii.op4_pii,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_warc": warc.op6_warc,
    "op7_chat": chat.op7_chat,
    "op8_mixing": mixing.op8_mixing,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_packing": packing.op10_packing,
    "op11_pareto": pareto.op11_pareto,
    "op12_perplexity": perplexity.op12_perplexity,
    "op13_centroids": centroids.op13_centroids,
}

SQL: dict[str, str] = {
    "op2_quality": quality.SQL,
    "op6_warc": warc.SQL,
    "op7_chat": chat.SQL,
    "op8_mixing": mixing.SQL,
    "op9_jaccard": jaccard.SQL,
    "op11_pareto": pareto.SQL,
    "op13_centroids": centroids.SQL,
}
