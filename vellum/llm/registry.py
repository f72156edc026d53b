"""The queries of this subpackage by name, with SQL where it can express them."""

from __future__ import annotations

from . import extraction, fingerprints, jaccard, licenses, linededup, mixing, nearest, packing, quality, warc

QUERIES = {
    "op1_licenses": licenses.op1_licenses,
    "op2_mixing": mixing.op2_mixing,
    "op3_packing": packing.op3_packing,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_nearest": nearest.op5_nearest,
    "op6_fingerprints": fingerprints.op6_fingerprints,
    "op7_quality": quality.op7_quality,
    "op8_extraction": extraction.op8_extraction,
    "op9_linededup": linededup.op9_linededup,
    "op10_warc": warc.op10_warc,
}
ORACLE = {
    "op2_mixing": mixing.OP2_SQL,
    "op4_jaccard": jaccard.OP4_SQL,
    "op9_linededup": linededup.OP9_SQL,
    "op10_warc": warc.OP10_SQL,
}


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    return QUERIES | {"pipeline": pipeline}


def oracle_sql():
    return dict(ORACLE)
