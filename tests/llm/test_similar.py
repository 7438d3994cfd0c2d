"""The pipeline's near-duplicate stage against brute force over all pairs of shingle sets."""
import random
import re
from collections import Counter
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge import scratch
from tallyforge.llm import similar

from .test_operators import ODD, WORDS, brute_components, documents, prose


def brute_shingles(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def brute_groups(rows):
    sets = sorted({frozenset(brute_shingles(t)) for _, t, *_ in rows}, key=lambda s: sorted(s))
    label = brute_components(len(sets), lambda i, j: alike(sets[i], sets[j]))
    return {s: c for s, c in zip(sets, label, strict=True)}


def changed(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS) + "x"
    return " ".join(w)


@pytest.mark.parametrize(("block", "sets"), [(2048, 256), (8, 4)])
def test_stage_keeps_one_of_each_group(spark, block, sets, monkeypatch):
    """Copies with few words changed are all candidates; small blocks must give the same groups."""
    full, apart = similar.candidates, similar.apart
    monkeypatch.setattr(similar, "candidates", lambda nodes, scratch: full(nodes, scratch, block=block))
    monkeypatch.setattr(similar, "apart", lambda members, texts: apart(members, texts, sets))
    rng = random.Random(8)
    common = prose(rng, 40)
    rows = [(i, prose(rng, rng.randint(3, 200)) + (" " + common if i % 2 else ""), "en", "a") for i in range(60)]
    base = prose(rng, 150)
    rows += [(100 + i, changed(rng, base, 1), "en", "a") for i in range(40)]  # one large group
    rows += [(200 + i, changed(rng, rows[i][1], 1) if len(rows[i][1].split()) > 80 else rows[i][1], "en", "a") for i in range(50)]
    rows += [(d and d + 1000, *r) for d, *r in ODD]
    docs = documents(spark, rows)
    kept = similar.keep_one(docs)
    assert kept.columns == docs.columns
    group = brute_groups(rows)
    least = {}
    for d, t, *_ in rows:
        c = group[frozenset(brute_shingles(t))]
        least[c] = min(least.get(c, 10**9), 10**9 if d is None else d)
    got = Counter(10**9 if r["doc_id"] is None else r["doc_id"] for r in kept.collect())
    assert got == Counter(least.values())


def test_recall_and_precision_at_the_threshold(spark):
    """Chains of copies around Jaccard 0.8: no group holds what brute force keeps apart, and at least 0.9 of the copies go."""
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randint(60, 300)), "en", "a") for i in range(80)]
    for i in range(80, 480):
        t = rows[rng.randrange(i)][1]
        rows.append((i, changed(rng, t, rng.randint(1, max(1, len(t.split()) // 55))), "en", "a"))
    group = brute_groups(rows)
    of = {d: group[frozenset(brute_shingles(t))] for d, t, *_ in rows}
    left = Counter(of[r["doc_id"]] for r in similar.keep_one(documents(spark, rows)).collect())
    groups = len(set(of.values()))
    assert groups < 400 and set(left) == set(of.values())  # at least one of each exact group stays
    assert len(rows) - sum(left.values()) >= 0.9 * (len(rows) - groups)


def test_stage_of_nothing(spark):
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, "").count() == 0


@given(st.lists(st.integers(0, 60), max_size=40), st.lists(st.integers(0, 60), max_size=40))
@settings(max_examples=300, deadline=None)
def test_similar(a, b):
    assert similar.similar(np.unique(np.array(a, "u8")), np.unique(np.array(b, "u8"))) == alike(set(a), set(b))


@given(st.integers(1, 12), st.lists(st.tuples(st.integers(0, 11), st.integers(0, 11)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_forest(n, pairs):
    pairs = [(a % n, b % n) for a, b in pairs if a % n != b % n]
    a, b = (np.array([p[k] for p in pairs], "i8") for k in (0, 1))
    keep = similar.forest(n, a, b)
    chosen = {pairs[k] for k in keep}
    one = brute_components(n, lambda i, j: (i, j) in set(pairs) or (j, i) in set(pairs))
    assert one == brute_components(n, lambda i, j: (i, j) in chosen or (j, i) in chosen)
    assert len(keep) == n - len(set(one))


def test_slim_tables_come_in_few_files(spark, tmp_path, monkeypatch):
    """However many files the documents come in, sizes and verified edges are written in one while they are small, without a marker that would be one more file."""
    rng = random.Random(5)
    base = [prose(rng, 150) for _ in range(20)]
    docs = documents(spark, [(i, changed(rng, base[i % 20], i // 20 % 2), "en", "a") for i in range(80)]).repartition(8)
    written, cut = [], scratch.Scratch.cut

    def counted(self, df, *args, **more):
        out = cut(self, df, *args, **more)
        folder = Path(f"{self.root}/{self.n}".removeprefix("file://"))
        written.append((df.columns, len(list(folder.glob("part-*"))), (folder / "_SUCCESS").exists()))
        return out

    monkeypatch.setattr(scratch.Scratch, "cut", counted)
    corpus_pipeline.mix(spark, similar.keep_one(docs.union(docs.limit(5))).repartition(8), "").collect()
    assert {n for c, n, _ in written if c[:2] in (["doc_id", "source"], ["a", "b"], ["id", "h"])} == {1}
    assert not [c for c, _, marked in written if marked]
