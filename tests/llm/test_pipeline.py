"""The pipeline's stages, the entry module with and without the subpackage, and the SQL of op2."""
import os
import subprocess
import sys

from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import bpe, langid, mixing, similar, zstdclass
from tallyforge.llm.queries import ORACLES, QUERIES

from .test_operators import ODD, documents
from .test_similar import brute_groups, brute_shingles

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    seen = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, DATA).persist()
        if k < 4:
            assert out.columns == docs.columns, name
        if name == "quality":
            good = {r["doc_id"] for r in out.collect()}
            assert sum(labels[i] for i in good if i in labels) >= 0.95 * sum(labels.values())
        docs = out
        seen.append(out.count())
    assert seen[0] > seen[1] >= seen[2] > seen[3] and seen[4] == seen[5] > 0


def test_run_against_the_stages_by_hand(spark):
    """run()'s rows, made again from whole texts: scores and far-off texts by the models in plain Python, near-duplicates over all pairs of shingle sets, copies by the mix's own table, ids by the library."""
    import hashlib

    import tiktoken

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{DATA}/documents.parquet")
    model = zstdclass.fit(frame, spark.read.parquet(f"{DATA}/labels.parquet"))
    of = model.difference()
    good = {i for i, r in docs.items() if model.score(np.array([of((r["text"] or "").encode())]))[0] >= 0.7}
    kept = frame.where(F.col("doc_id").isin(list(good)))
    lang = langid.fit(kept)
    near = set()
    for i in good:
        c = langid.counts(docs[i]["text"] or "")
        if c is not None and not lang.predict(c[None])[2][0]:
            near.add(i)
    group = brute_groups([(i, docs[i]["text"]) for i in near])
    of_doc = {i: group[frozenset(brute_shingles(docs[i]["text"]))] for i in near}
    left = [r["doc_id"] for r in similar.keep_one(frame.where(F.col("doc_id").isin(list(near)))).collect()]
    groups = len(set(of_doc.values()))  # of exact Jaccard: none is lost, and nine in ten of the copies go
    assert {of_doc[i] for i in left} == set(of_doc.values()) and len(near) - len(left) >= 0.9 * (len(near) - groups)
    mixed = {r["doc_id"]: r["copies"] for r in mixing.mix(frame.where(F.col("doc_id").isin(left))).collect()}
    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    want = Counter()
    for i, n in mixed.items():
        ids = enc.encode_ordinary(docs[i]["text"] or "")
        if n:
            want[i, docs[i]["source"], docs[i]["lang"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()] = n
    got = Counter((r["doc_id"], r["source"], r["lang"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, DATA).collect())
    assert got == want


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empties, repeated rows and clashing columns pass through every stage; without labels or languages nothing is dropped for lack of a model."""
    docs = documents(spark, ODD)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    with pytest.warns(UserWarning, match="quality"):
        assert sorted(map(str, corpus_pipeline.quality(spark, docs, str(tmp_path)).collect())) == sorted(map(str, docs.collect()))
    unknown = docs.withColumn("lang", F.lit(None).cast("string"))
    with pytest.warns(UserWarning, match="language"):
        assert corpus_pipeline.language(spark, unknown, "").count() == len(ODD)
    mixed = corpus_pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns
    got = corpus_pipeline.tokens(spark, docs, "").collect()
    assert len(got) == len(ODD)
    want = Counter((d, lang, source, len(t or "")) for d, t, lang, source in ODD)
    import tiktoken

    enc = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert Counter((r["doc_id"], r["lang"], r["source"], len(enc.decode(r["ids"]))) for r in got) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)


def test_vectors_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS FROM '{DATA}/embeddings.parquet'")
    want = sorted(con.execute(f"SELECT vec_id, n_links, component_id, kept FROM ({ORACLES['op2_embedding_neardup']})").fetchall())
    got = sorted(tuple(r) for r in QUERIES["op2_embedding_neardup"](spark, DATA).select("vec_id", "n_links", "component_id", "kept").collect())
    assert got == want


@pytest.mark.parametrize("pipeline_left", [False, True])
def test_entry_without_the_subpackage(tmp_path, pipeline_left):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import shutil

    shutil.copytree(f"{root}/tallyforge", tmp_path / "tallyforge", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    if pipeline_left:
        shutil.copy(f"{root}/corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and len(q) > 40 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
