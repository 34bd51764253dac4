"""The pipeline and the registered queries of the package."""

import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from candlewright.llm import decontaminate, langid, simhash
from candlewright.llm.common import stored, table
from candlewright.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def shingles(text):
    """Runs of five words; a shorter text is one run."""
    w = text.lower().split()
    return {" ".join(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", QUERIES)
def test_query_covers_its_table(spark, name):
    rows = QUERIES[name](spark, FOLDER).collect()
    docs = table(spark, FOLDER, "documents").count()
    if name == "op2_neighbours":
        assert len(rows) == 5 * table(spark, FOLDER, "embeddings").where("vec_id % 50 = 0").count()
    elif name == "op11_centroid_clusters":
        assert len(rows) == table(spark, FOLDER, "embeddings").count()
    elif name == "op13_prefix_trie":
        turns = table(spark, FOLDER, "conversations").count()
        assert 0 < len(rows) <= turns + 1 + 3 * table(spark, FOLDER, "conversations").select("conv_id").distinct().count()
    elif name != "op5_decontamination":
        assert len(rows) == docs


def test_stages_one_by_one(spark):
    """Each stage against its plain counterpart on the same rows."""
    docs = table(spark, FOLDER, "documents")
    results, columns = [docs], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        results.append(stored(stage(spark, results[-1], FOLDER)))
        if name != "token_file":
            assert results[-1].columns == columns, name
    read, known, single, clean, mixed, final = [r.collect() for r in results]

    model = langid.fitted(docs)
    assert {r.doc_id for r in known} == {r.doc_id for r in read if model.predict(r.text)[2]}

    sets = {r.doc_id: shingles(r.text) for r in known}
    kept = {r.doc_id for r in single}
    for a in sets:
        alike = [b for b in sets if b != a and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85]
        assert a in kept or any(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.6 for b in sets if b < a)
        assert a not in kept or not any(b in kept for b in alike)

    items = [decontaminate.TOKEN.findall(r.text.lower()) for r in table(spark, FOLDER, "benchmark").collect()]
    tokens = {r.doc_id: " " + " ".join(decontaminate.TOKEN.findall(r.text.lower())) + " " for r in single}
    whole = {d for d, t in tokens.items() for i in items if f" {' '.join(i)} " in t}
    windows = {" ".join(i[k:k + 13]) for i in items for k in range(max(1, len(i) - 12))}
    gone = kept - {r.doc_id for r in clean}
    assert whole <= gone and all(any(f" {w} " in tokens[d] for w in windows) for d in gone)

    words = {r.doc_id: set(r.text.split()) for r in clean}
    assert all(set(r.text.split()) <= words[r.doc_id] and r.n_chars == len(r.text) for r in mixed)

    from tokenizers import Tokenizer

    coder, start, want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), 0, []
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = coder.encode(r.text, add_special_tokens=False).ids + [2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, final)) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == want


def test_near_copies_of_the_tables_have_similar_shingles(spark):
    docs = table(spark, FOLDER, "documents")
    text = {r.doc_id: r.text for r in docs.collect()}
    groups = {}
    for r in simhash.near_copies(docs).collect():
        groups.setdefault(r.component_id, []).append(r.doc_id)
    for ids in groups.values():
        sets = [shingles(text[i]) for i in ids]
        for k, a in enumerate(sets):
            assert len(ids) == 1 or max(len(a & b) / max(1, len(a | b)) for j, b in enumerate(sets) if j != k) > 0.6
