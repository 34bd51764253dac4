"""Stages that turn ``documents`` into a mixed, tokenized training corpus."""

from candlewright.llm import decontaminate, langid, mixing, simhash, tokenfiles
from candlewright.llm.common import scratch_path, stored, table


def known_language(spark, docs, sf_dir):
    """Documents whose language the model accepts; it is trained on the labelled rows of its input."""
    return langid.known_languages(docs)


def without_copies(spark, docs, sf_dir):
    """One document of each group of near copies: the smallest doc_id."""
    return simhash.keep_one(docs)


def without_leaks(spark, docs, sf_dir):
    """Documents that hold no benchmark item, as it is or with other numbers and names."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark, docs, sf_dir):
    """The words that each document gives to the mix."""
    return mixing.mixed_documents(docs)


def token_file(spark, docs, sf_dir):
    """One row per document as read back from the token file that the stage writes."""
    return tokenfiles.read_token_file(spark, tokenfiles.write_token_file(docs, scratch_path(spark)))


STAGES = [
    ("language", known_language),
    ("near_copies", without_copies),
    ("decontamination", without_leaks),
    ("mixing", mixed),
    ("token_file", token_file),
]

# Trained models, fingerprints and a tokenizer have no SQL; the tests compare plain loops.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
