"""The pipeline stage by stage against plain versions, and its registered queries."""

from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import pyarrow as pa
from introspark.llm import mixing, quality_rules
from introspark.llm.common import QUERIES, land
from introspark.llm.common import table as read

from . import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = read(spark, FOLDER, "documents")
    model = quality_rules.fit(docs, read(spark, FOLDER, "labels"), neighbours=False)
    for name, stage in corpus_pipeline.STAGES:
        rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
        out = land(stage(spark, docs, FOLDER), name)
        got = out.collect()
        if name == "quality_rules":
            verdict = {r["doc_id"]: r["kept"] for r in quality_rules.assess(docs, model).collect()}
            assert sorted(r["doc_id"] for r in got) == sorted(i for i in verdict if verdict[i])
            assert all(not brute.base_counts(r["text"])[-1] for r in got)
        elif name == "exact_dedup":
            assert sorted(r["doc_id"] for r in got) == sorted(w[0] for w in brute.exact([r[:2] for r in rows]) if w[3])
        elif name == "ngram_join":
            assert sorted(r["doc_id"] for r in got) == sorted({c for _, _, c in brute.similar([r[:2] for r in rows])})
        elif name == "mixing":
            connection = duckdb.connect()
            connection.register("documents", pa.table(dict(zip(("doc_id", "text", "source"), zip(*rows, strict=True), strict=True))))
            want = {i: n for i, n in connection.execute(f"SELECT doc_id, taken FROM ({mixing.MIX_SQL})").fetchall() if n}
            words = defaultdict(int)
            for r in got:
                words[r["doc_id"]] += len(brute.WORD.findall(r["text"]))
            assert words == want
        else:
            total = Counter()
            for r in got:
                total[r["doc_id"]] += r["length"]
            tokens = {(r["doc_id"], r["doc_tokens"]) for r in got}
            copies = Counter(i for i, _, _ in rows)
            assert total.keys() == copies.keys() and all(n >= copies[i] for i, n in total.items()) and len(tokens) <= len(rows)
        if name != "packing":
            assert out.columns == docs.columns
        docs = out
    assert corpus_pipeline.run(spark, FOLDER).count() == docs.count()


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
