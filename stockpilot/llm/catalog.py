"""Registered queries of the subpackage and their DuckDB SQL."""

from __future__ import annotations

from stockpilot.llm import byte_bpe, exact_dedup, html_extract, langid, licenses, near_dedup, packing, phrases, quality, sharding, simhash, spelling, warc


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {
    "op1_pack": packing.op1_pack,
    "op2_html_text": html_extract.op2_html_text,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_warc": warc.op5_warc,
    "op6_shard": sharding.op6_shard,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_langid": langid.op9_langid,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_license": licenses.op11_license,
    "op12_phrases": phrases.op12_phrases,
    "op13_spelling": spelling.op13_spelling,
}

ORACLE = {"op4_exact_dedup": exact_dedup.ORACLE, "op5_warc": warc.ORACLE, "op12_phrases": phrases.ORACLE}
