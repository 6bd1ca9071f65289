import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    sizes = [docs.count()]
    for i, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        sizes.append(docs.count())
        if i + 1 < len(pipeline.STAGES):
            assert docs.columns == columns, name
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4] == sizes[5]
    assert docs.select("doc_id").distinct().count() == sizes[-1]


def test_every_stage_takes_odd_rows(spark):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "mail a@b.org", "en", "s", 12, "x"), (3, "w " * 70000, "de", "s", 140000, "x"), (3, "w " * 70000, "de", "s", 140000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `_name` string")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, SF).count() <= len(rows)
        assert stage(spark, docs.where("false"), SF).count() == 0


def test_every_stage_equals_plain_python(spark, tmp_path):
    """The whole run on a small table, stage by stage, against scores, sets, passages, patterns and the library."""
    from test_minhash import brute
    from test_spans import personal
    from test_texts import brute_leaks

    from fieldloom.llm import bpe, pii, quality
    from fieldloom.llm.queries import word_bpe_path

    stages = dict(pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 5"))  # rows that repeat an id
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    read = lambda df: [r.asDict() for r in df.collect()]
    key = lambda rows: sorted((r["doc_id"], r["text"] or "") for r in rows)

    def staged(name, docs):
        stages[name](spark, docs, SF).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    rows = read(docs)
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = model.score(np.array([quality.statistics(r["text"]) for r in rows], float)) >= pipeline.QUALITY
    docs = staged("quality classifier", docs)
    rows = [r for r, ok in zip(rows, good) if ok]
    assert key(read(docs)) == key(rows)

    root = brute([(r["doc_id"], r["text"]) for r in rows], 100, pipeline.SIMILARITY)
    docs = staged("MinHash near-dedup", docs)
    rows = list({r["doc_id"]: r for r in rows if root[r["doc_id"]] == r["doc_id"]}.values())
    assert key(read(docs)) == key(rows)

    leaked = {d for d, _ in brute_leaks([(r["doc_id"], r["text"]) for r in rows], bench)}
    docs = staged("benchmark decontamination", docs)
    rows = [r for r in rows if r["doc_id"] not in leaked]
    assert leaked and key(read(docs)) == key(rows)

    models = pii.learn(docs)
    more = {r.doc_id: [(s["start"], s["end"], s["kind"]) for s in r.spans] for r in pii.scan(docs, models).collect()}
    docs = staged("PII", docs)

    def redacted(r):
        out, at, last = "", 0, 0
        base = [(a, b, k) for a, _, b, k in personal(r["text"] or "")]
        assert set(base) <= set(more[r["doc_id"]])
        for a, b, k in sorted(more[r["doc_id"]], key=lambda s: (s[0], pii.KINDS.index(s[2]))):
            if a >= at:
                out += (r["text"] or "")[at:a] + f"[{k.upper()}]"
            at = max(at, b)
        return out + (r["text"] or "")[at:]

    want = [{**r, "text": redacted(r)} for r in rows]
    assert key(read(docs)) == key(want) and want != rows

    tokenizer = bpe.load(open(word_bpe_path(), encoding="utf-8").read())
    for r in read(staged("BPE encoding and decoding", docs)):
        ids = tokenizer.encode(next(w["text"] for w in want if w["doc_id"] == r["doc_id"]), add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_no_column_of_the_input_is_overwritten(spark):
    """Columns named like those that the stages make keep their values."""
    names = ["spans", "base", "redacted", "quality_score", "doc", "row", "_row", "text_hash", "n", "kept", "score"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    docs = docs.select("*", *[F.concat(F.lit(f"{c} of "), F.col("doc_id").cast("string")).alias(c) for c in names])
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[c] == f"{c} of {r.doc_id}" for r in rows for c in names), name
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()


def test_a_run_leaves_only_the_stage_that_the_last_one_reads(spark):
    import glob
    import os

    from fieldloom.llm.common import checkpoint_folder

    folder = checkpoint_folder(spark).removeprefix("file:")
    before = set(glob.glob(f"{folder}/pipeline-*"))
    assert pipeline.run(spark, SF).count() > 0
    (made,) = set(glob.glob(f"{folder}/pipeline-*")) - before
    assert os.listdir(made) == [str(len(pipeline.STAGES) - 2)]
