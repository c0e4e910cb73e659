"""A training corpus from raw documents, stage by stage.

Every stage reads what the one before it wrote.  All but the last return the
columns of ``documents``; the last returns pieces of packed sequences.
"""

from __future__ import annotations

import public_tokenizers

from evalsweep.llm import near_texts, packing, pii, repeats, toxicity
from evalsweep.llm.common import bounded_batches, staged, table


def toxic(spark, docs, sf_dir):
    """Drop documents whose restored words score as toxic."""
    bounded_batches(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    """Keep the document of smallest id of each group of near copies."""
    bounded_batches(spark)
    return near_texts.drop_near_duplicates(docs)


def repeated_passages(spark, docs, sf_dir):
    """Cut passages of 200 bytes and more that stand anywhere else too."""
    bounded_batches(spark)
    return repeats.remove_repeats(docs)


def private(spark, docs, sf_dir):
    """Replace personal data by placeholders."""
    bounded_batches(spark)
    return pii.redact(docs)


def packed(spark, docs, sf_dir):
    """Pack documents into sequences of at most 1024 ids."""
    bounded_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("pii", private),
    ("packing", packed),
]

# No SQL for learned scores, minimum hashes or byte pair ids: see tests/llm.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each is stored before the next begins."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
