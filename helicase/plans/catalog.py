"""Registry of the engine's own queries and their SQL twins."""

from helicase.plans import base, packing, sequences, storage  # noqa: F401

QUERIES = base.QUERIES
ORACLE_SQL = base.ORACLE_SQL


def FLAGSHIP(spark, sf_dir):
    return QUERIES["seq_strand_quality"](spark, sf_dir)
