"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from reliefspark.llm import bpe, decontaminate, langid, linededup, neardup, oracles, quality, sharding, tokenfiles, toxicity, warc


def queries() -> dict:
    return {"op1_warc": warc.op1_warc, "op2_bpe": bpe.op2_bpe, "op3_tokens": tokenfiles.op3_tokens, "op4_shards": sharding.op4_shards, "op5_langid": langid.op5_langid, "op6_neardup": neardup.op6_neardup, "op7_toxicity": toxicity.op7_toxicity, "op8_linededup": linededup.op8_linededup, "op9_quality": quality.op9_quality, "op10_decontaminate": decontaminate.op10_decontaminate, "shard_law": sharding.shard_law}


def oracle_sql() -> dict[str, str]:
    """The others have no SQL: tests hold them against brute force, the libraries or held-out labels."""
    return {"op1_warc": oracles.OP1, "op6_neardup": oracles.OP6, "op8_linededup": oracles.OP8, "op9_quality": oracles.OP9, "shard_law": oracles.SHARD_LAW}
