"""The pipeline against direct versions of its stages on a small table."""

import zlib

import numpy as np

import corpus_pipeline
from factloom.llm import classifier, rules

from .test_quality import plain as counts
from .test_repeats import brute as brute_repeats
from .test_shingles import brute_kept
from .test_tokens import plain as ids_of

SF = "/root/testdata/sf0.001"


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    verdict = {r.doc_id: r.kept for r in rules.quality_rules(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if verdict[r.doc_id])
    assert not any(counts(t)[-1] for _, t in rows)
    train = [(d, t) for d, t in rows if d in labels and zlib.crc32(str(d).encode()) % 5]
    model = classifier.fit(np.array([classifier.features(t) for _, t in train]), np.array([float(labels[d]) for d, _ in train]))
    rows = [r for r, s in zip(rows, model.score(np.array([classifier.features(t) for _, t in rows])), strict=True) if s >= 0.3]
    first = set(brute_kept(rows))
    rows = [r for r in rows if r[0] in first]
    left = {}
    for d, n, gone, _, _ in brute_repeats(rows):
        left[d] = n - gone
    found = corpus_pipeline.run(spark, SF).collect()
    texts = dict(rows)
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert set(by_doc) == set(texts)
    for d, pieces in by_doc.items():
        ids = np.frombuffer(b"".join(bytes(p.ids) for p in sorted(pieces, key=lambda p: p.start)), "<u4").tolist()
        assert len(ids) == pieces[0].doc_tokens and ids[-1] == 2
        if left[d] == len(texts[d].encode()):
            assert ids == [*ids_of(texts[d]), 2]


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, docs, SF).columns == docs.columns


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, function in corpus_pipeline.STAGES:
        assert function(spark, docs, SF).count() == 0
