import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from slotweave.llm import quality, rules

from .test_nearcopies import brute_groups
from .test_packing import check


def test_registered():
    names = {q.split("_")[0] for q in entry.queries() if q.startswith("op")}
    assert names == {f"op{n}" for n in range(1, 14)} and "pipeline" in entry.queries()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "best_fit_packing"]


def test_run_equals_brute_force(spark, sf_dir, tables):
    got = corpus_pipeline.run(spark, sf_dir).collect()
    docs, labels = tables("documents"), tables("labels")
    found = rules.learn_from(docs, labels)
    rows = []
    for r in docs.collect():
        s = dict(zip([c.split()[0] for c in rules.SCHEMA.split(",")], rules.statistics(r["text"])))
        holds = lambda c: s[c.name] >= c.threshold if c.above else s[c.name] < c.threshold
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        if not failed and not any(all(map(holds, rule)) for rule in found):
            rows.append(r)
    left = spark.createDataFrame(rows, docs.schema)
    model, features = quality.train(left, labels), quality.Features()
    rows = [r for r in rows if quality.logistic(float(model[(f := features(r["text"]))[0]] @ f[1])) >= quality.KEEP]
    rows.sort(key=lambda r: r["doc_id"])  # of each group the smallest id stays
    first = {rows[g]["doc_id"] for g in brute_groups([r["text"] for r in rows])}
    rows = [(r["doc_id"], r["text"]) for r in rows if r["doc_id"] in first]
    assert {r["doc_id"] for r in got} == first
    check(got, rows, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_stages_keep_columns_and_take_odd_rows(spark, sf_dir, tables):
    docs = tables("documents")
    odd = docs.limit(3).unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (-1, None, None, None, None), (-2, "", "", "", 0)], docs.schema))
    for name, step in corpus_pipeline.STAGES[:-1]:
        for rows in (odd, docs.limit(0)):
            out = step(spark, rows, sf_dir)
            assert out.columns == docs.columns
            out.collect()
    assert corpus_pipeline.near_duplicates(spark, odd, sf_dir).count() == 4  # texts without words are one group
