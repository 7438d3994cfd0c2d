"""The operators against brute force, and their defined results for odd input."""
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import bpe, common, langid, mixing, neardup, ordering, outliers, sharding, simhash, urlfilter, zstdclass
from tallyforge.llm.common import Scratch, components, running
from tallyforge.llm.queries import RULES

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = "the of and tion ing er in on at en re is es the and un le der die das que con para por".split()


def prose(rng: random.Random, n: int, words=WORDS) -> str:
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


def documents(spark, rows):
    """Extra columns have the names that operators use for their own."""
    full = [(*r, 1, "x", 0.5, True, 3) for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, size long, fp string, score double, kept boolean, shard int")


ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, None), (None, "some words here to read", "de", "a"), (4, "word", "en", "b"), (4, "word", "en", "b"), (5, "a b " * 30_000, "en", None), (6, "1234 !!! 99", "fr", "c"), (7, "日本語 テキスト 🙂 ÄÖÜ ß", "ja", "c")]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = ("en", "de")[i % 2]
        text = prose(rng, rng.randint(3, 120), WORDS[:12] if lang == "en" else WORDS[12:])
        rows.append((i, text, lang, f"s{i % 3}" if i % 9 else None))
    for i in range(240, 300):  # copies, some with a word changed
        t, lang = rows[i % 40][1:3]
        rows.append((i, t if i % 2 else t + " extra", lang, "s0"))
    return rows + [(d and d + 1000, *r) for d, *r in ODD]


def brute_components(n, linked):
    label = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                if a != b:
                    label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_components_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect())
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(60)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_running(spark):
    df = spark.createDataFrame([(i * 7 % 100, i % 5) for i in range(100)], "k long, v long")
    got = sorted(running(df, ["k"], "v", Scratch(spark, "t")).collect())
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["v"]


# op1


@given(n=st.integers(0, 3000), key=st.integers(0, 2**40))
@settings(max_examples=30, deadline=None)
def test_permutation(n, key):
    p = ordering.permute(np.arange(n), n, key)
    assert sorted(p.tolist()) == list(range(n))
    assert (ordering.permute(p, n, key, inverse=True) == np.arange(n)).all()


LONG = [(3000, " " * 2_000_000 + "x", "en", "a"), (3001, "ab" * 4000, "en", "a")]


def test_training_order(spark, corpus, tmp_path):
    out = f"file://{tmp_path}/shards"
    rows = ordering.materialise(documents(spark, corpus + LONG), RANKS, P.PATTERN, key=3, length=16, shard_bytes=300_000, out=out).collect()
    mine = bpe.Bpe(RANKS, P.PATTERN)
    want, ids_of = Counter(), {}
    for doc, text, *_ in corpus + LONG:
        ids = next(iter(mine.encode_texts([text]))).astype("<u2")
        for j in range(0, len(ids), 16):
            key = (doc, j // 16, hashlib.sha256(ids[j : j + 16].tobytes()).hexdigest())
            want[key] += 1
            ids_of[key] = ids[j : j + 16]
    assert Counter((r["doc_id"], r["seq_no"], r["ids_sha256"]) for r in rows) == want
    assert sorted(r["slot"] for r in rows) == list(range(len(rows)))
    by = {r["slot"]: r for r in rows}
    shards = sorted({r["shard"] for r in rows})
    assert len(shards) > 3
    # a record is read by its offset alone
    files = {k: next((tmp_path / "shards" / f"shard={k}").glob("part-*")).read_bytes() for k in shards}
    step = ordering.stride(16)
    assert sum(map(len, files.values())) == step * len(rows)
    for slot in range(0, len(rows), 97):
        r = by[slot]
        raw = files[r["shard"]][r["byte_offset"] : r["byte_offset"] + step]
        ids = ids_of[r["doc_id"], r["seq_no"], r["ids_sha256"]]
        assert (np.frombuffer(raw, "<u2", len(ids)) == ids).all() and (np.frombuffer(raw, "<u2", 16)[len(ids) :] == ordering.PAD).all()
    # slots follow the files in the order of the shards, and the reader goes on from any of them
    assert [r["shard"] for _, r in sorted(by.items())] == sorted(r["shard"] for r in rows)
    start = len(rows) - 75
    got = list(ordering.read_from(spark, out, start, 16, chunk=10))
    assert [x for x, _ in got] == list(range(start, len(rows)))
    assert all(hashlib.sha256(ids.tobytes()).hexdigest() == by[x]["ids_sha256"] for x, ids in got)
    assert ordering.materialise(documents(spark, []), RANKS, P.PATTERN).count() == 0


def test_training_order_does_not_depend_on_file_splits(spark, corpus, tmp_path):
    documents(spark, corpus[:200]).repartition(3).write.parquet(f"file://{tmp_path}/docs")
    seen = []
    for size in ("134217728", "4096"):
        old = spark.conf.get("spark.sql.files.maxPartitionBytes")
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            docs = spark.read.parquet(f"file://{tmp_path}/docs")
            seen.append(sorted(map(str, ordering.materialise(docs, RANKS, P.PATTERN, key=5, length=16, shard_bytes=20_000).collect())))
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert seen[0] == seen[1]


# op2


@pytest.mark.parametrize("dim", [2, 8, 64])
def test_embedding_links(spark, dim):
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(400, dim))
    v[200:300] = v[:100] + rng.normal(size=(100, dim)) * np.linalg.norm(v[:100], axis=1)[:, None] * 0.3 / math.sqrt(dim)
    v[300:330] = v[7]
    v[330] = v[7] * 2.5
    rows = [(int(i), [float(x) for x in v[i]], 1) for i in range(400)]
    rows += [(400, None, 1), (401, [0.0] * dim, 1), (402, [float("nan")] * dim, 1), (403, [None] + [1.0] * (dim - 1), 1), (404, [], 1), (405, [float("inf")] * dim, 2), (406, [1.0] * (dim + 1), 2), (None, [float(x) for x in v[9]], 2)]
    got = {r["vec_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), block=64).collect()}
    assert len(got) == len(rows)
    ids, x = [*range(400), None], np.concatenate([v, v[[9]]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    label = brute_components(401, lambda i, j: link[i, j])
    least = {}
    for i, c in zip(ids, label, strict=True):
        if i is not None:
            least[c] = min(least.get(c, 10**9), i)
    for k, i in enumerate(ids):
        assert got[i]["n_links"] == link[k].sum() - 1, i
        assert got[i]["component_id"] == least[label[k]]
    for i in range(400, 407):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert neardup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# op3


def test_url_rules(spark):
    rows = [
        (1, "https://WWW.A.example.org/es/x?q#f"), (2, "http://example.org/en/12"), (3, "http://example.org/en/2"), (4, "http://x.com/fr/"), (5, "http://x.com/de"), (6, None), (7, "no scheme"), (8, "http://org"), (9, "http://nexample.org/es/1"),
        (10, "http://h?a=://b/c"), (11, "http://x.com/de/1"), (12, "http://Ä.example.org/es/"),
    ]
    pages = spark.createDataFrame([(i, u, None, "v") for i, u in rows], "page_id long, url string, html string, verdict string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.filter_urls(pages, RULES).collect()}
    assert got[1] == ("www.a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("example.org", "/en/2", "org/", "allow")
    assert got[4] == ("x.com", "/fr/", "com/fr/", "allow")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("org", "", None, "allow")
    assert got[9] == ("nexample.org", "/es/1", "org/", "allow")
    assert got[10] == ("h", "", None, "allow")
    assert got[11] == ("x.com", "/de/1", "com/de/", "block")
    assert got[12][0] == "Ä.example.org"


def test_redirect_aliases(spark):
    link = lambda u: f'<html><head><link data-x="1" rel="canonical" href="{u}"></head>'
    rows = [
        (1, "http://a.net/1", link("http://b.net/2")), (2, "http://b.net/2", link("/3?a=1&amp;b=2")), (3, "http://b.net/3?a=1&b=2", "<meta http-equiv='refresh' content='0; url=http://x.com/de/9'>"), (4, "https://www.a.net/1/?utm_source=z#t", ""),
        (5, "http://c.net/1", link("http://bad.com/de/1")), (6, "http://good.org/1", link("http://c.net/1")), (7, "http://d.net/", None), (8, "http://e.net/p", link("q")), (9, "http://e.net/q", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://d.net", "http://bad.com/de/2"), (None, "http://z.net/")], "src string, dst string")
    got = {r["page_id"]: r["verdict"] for r in urlfilter.filter_urls(pages, RULES, redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow"}
    assert urlfilter.filter_urls(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0


def test_aliases_against_union_find(spark):
    """Random redirects between spellings of few addresses, pages or not, repeated and tied rules: verdicts as union-find over plain Python spellings gives them."""
    rng = random.Random(7)
    rules = [*RULES, urlfilter.Rule("net", "/a", "block"), urlfilter.Rule("net", "/a", "allow"), urlfilter.Rule("x.net", "/", "allow")]
    bare = [f"{h}/{p}" for h in ("a.net", "x.net", "b.com", "c.org", "example.org") for p in ("a", "de/1", "fr/2", "es/3", "k", "m")]
    dress = lambda u: rng.choice(["http://", "https://"]) + rng.choice(["", "www."]) + u + rng.choice(["", "/", "#f", "?utm_source=q", "/index.html"])
    urls = [dress(rng.choice(bare[:24])) for _ in range(60)]
    pages = [(i, u, None) for i, u in enumerate(urls)] + [(None, urls[0], ""), (98, urls[1], None), (99, "http://long.net/" + "z" * 200_000, None)]
    edges = [(dress(rng.choice(bare)), dress(rng.choice(bare))) for _ in range(14)] + [(None, urls[0]), (urls[2], "no address")]

    def spell(u):
        m = re.match(r"https?://(?:www\.)?([^?#]*)", u)
        return "https://" + re.sub(r"/+$", "", re.sub(r"/index\.html$", "/", m[1]))

    def judge(u):
        m = re.match(r".*?://([^/?#]*)([^?#]*)", u)
        fits = [r for r in rules if (m[1] == r.host or m[1].endswith("." + r.host)) and m[2].startswith(r.path)]
        return max(fits, key=lambda r: (len(r.text), [-ord(c) for c in r.text], r.verdict == "block")).verdict if fits else None

    nodes = sorted({u for _, u, _ in pages} | {u for e in edges if None not in e and "no address" not in e for u in e})
    linked = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    label = brute_components(len(nodes), lambda i, j: spell(nodes[i]) == spell(nodes[j]) or (nodes[i], nodes[j]) in linked or any((spell(a), spell(b)) in ((spell(nodes[i]), spell(nodes[j])), (spell(nodes[j]), spell(nodes[i]))) for a, b in edges if a and "://" in b))
    said = {}
    for u, c in zip(nodes, label, strict=True):
        said.setdefault(c, set()).add(judge(u))
    of = dict(zip(nodes, label, strict=True))
    want = Counter((i, judge(u) or ("block" if "block" in said[of[u]] and "allow" not in said[of[u]] else "allow")) for i, u, _ in pages)
    got = urlfilter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string"), rules, spark.createDataFrame(edges, "src string, dst string"))
    assert Counter((r["page_id"], r["verdict"]) for r in got.collect()) == want
    # a blocked source of a redirect that is no page
    got = urlfilter.filter_urls(spark.createDataFrame([(1, "http://z.net/q", None)], "page_id long, url string, html string"), RULES, spark.createDataFrame([("http://x.com/de/1", "http://z.net/q")], "src string, dst string"))
    assert got.first()["verdict"] == "block"


# op4


def test_targets(spark):
    def of(*rows):
        df = spark.createDataFrame([("n" if r[0] is None else "s" + r[0], *r) for r in rows], "sid string, source string, size long, docs long")
        return {r["sid"]: round(r["target"], 6) for r in mixing.targets(df, Scratch(spark, "t"), [1.0, 2.0, 3.0], 3, len(rows)).collect()}

    assert of(("b", 100, 1), (None, 100, 1), ("a", 100, 1), ("c", 0, 1)) == {"sa": 75.0, "sb": 150.0, "sc": 0.0, "n": 75.0}
    assert of(("a", 1000, 1), ("b", 10, 1), ("c", 10, 1)) == {"sa": 960.0, "sb": 30.0, "sc": 30.0}
    many = of(*((f"{i:04}", 100, 1) for i in range(1200)))
    assert len(many) == 1200 and sum(many.values()) == pytest.approx(120_000)


@pytest.fixture(scope="module")
def mixed(spark, corpus):
    return mixing.mix(documents(spark, corpus)).collect()


def test_rates_against_the_dual(mixed):
    """Each source's rates are min(3, exp(t * size)) for the one t, found here by bisection, at which expected words meet the target."""
    by = {}
    for r in mixed:
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        sizes = np.array([r["size"] for r in rs], float)
        target, total = rs[0]["target"], sizes.sum()
        assert rs[0]["source_size"] == total
        if total == 0:
            continue
        rate = lambda t: np.minimum(3, np.exp(np.minimum(t * sizes / sizes.mean(), 5)))
        low, high = -3000.0, 3000.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if (rate(mid) * sizes).sum() < target else (low, mid)
        assert np.allclose([r["rate"] for r in rs if r["size"]], rate(low)[sizes > 0], rtol=1e-4)
        assert all(math.floor(r["rate"]) <= r["copies"] <= min(3, math.floor(r["rate"]) + 2) for r in rs)
        gap, short = sum(r["taken"] for r in rs) - target, [r for r in rs if r["size"] and r["copies"] < min(3, math.floor(r["rate"]) + 2)]
        if abs(gap) > 0.002 * target:  # then no document that could have a copy more comes nearer
            assert not short or min(r["size"] for r in short) > 2 * abs(gap) - 2 or gap > 0


def test_mix(spark, corpus, mixed):
    docs, rows = documents(spark, corpus), mixed
    assert len(rows) == len(corpus)
    again = mixing.mix(docs.repartition(7)).collect()
    assert Counter(map(str, rows)) == Counter(map(str, again))
    size = Counter(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in corpus)
    assert Counter(r["size"] for r in rows) == size
    by = {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        by.setdefault(r["source"], []).append(r)
    for s, rs in by.items():
        taken, big = sum(r["taken"] for r in rs), max(r["size"] for r in rs)
        assert abs(taken - rs[0]["target"]) <= max(0.02 * rs[0]["target"], big), s
    applied = mixing.apply_mix(docs)
    assert applied.columns == docs.columns
    assert applied.count() == sum(r["copies"] for r in rows)
    assert mixing.mix(documents(spark, [])).count() == 0


# op5


def test_shards(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(2, 30)), "en", "a") for i in range(900)]
    rows += [(1000 + i, rows[i % 100][1], "en", "a") for i in range(200)] + [(2000 + i, "same text of a large group", "en", "a") for i in range(600)] + [(3000, None, "en", "a"), (3001, None, "en", "a"), (None, "x", None, None), (5, "again", "en", "a")]
    got = sharding.assign(documents(spark, rows), shards=8).collect()
    assert len(got) == len(rows)
    size, slots = Counter(), {}
    for r in got:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["law"] == "bytes" and r["grown_shard"] is None
    assert set(size) == set(range(8))
    assert max(size.values()) - min(size.values()) <= 0.01 * sum(size.values()) / 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = {}
    for r in got:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    small = [where[x] for x in {__import__("zlib").crc32(rows[i][1].encode()) for i in range(100)}]
    assert sum(len(w) == 1 for w in small) >= 90  # links are rarely cut
    assert len(where[__import__("zlib").crc32(b"same text of a large group")]) <= 5
    assert sharding.assign(documents(spark, []), shards=8).count() == 0


def test_shards_of_odd_texts(spark):
    """Empty, null and very long texts, and one group that is nearly everything."""
    rows = ODD + [(100, "long " * 40_000, "en", "a"), (101, "", "en", "a")] + [(200 + i, "w" * 5000, "en", "a") for i in range(400)]
    got = sharding.assign(documents(spark, rows), shards=4).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((d, len((t or "").encode()) + 16) for d, t, *_ in rows)
    size = Counter()
    for r in got:
        size[r["shard"]] += r["size"]
    assert max(size.values()) - min(size.values()) <= 5016  # a document of the group
    alone = sharding.assign(documents(spark, [(1, "z" * 100_000, "en", "a")] + [(2 + i, f"{i} " * 100, "en", "a") for i in range(99)]), shards=4).collect()
    size = Counter()
    for r in alone:
        size[r["shard"]] += r["size"]
    assert sorted(size.values())[3] == 100_016 and max(list(sorted(size.values()))[:3]) - min(size.values()) <= 400  # one document fills a shard by itself


# op6


def brute_statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    c = Counter(win)
    hit = {j for i, x in enumerate(win) if c[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_statistics(spark, corpus):
    extra = [(900, "a b c a b c", "en", "a"), (901, "a b c d\na b c d\n\n \nx", "en", "a"), (902, "x x x x", "en", "a"), (903, "#*$ %&| <>", "en", "a"), (904, "a b c d", "en", "a"), (905, "\x1c a\x0bb\x0cc\x85d", "en", "a")]
    rows = corpus + extra
    got = outliers.judge(documents(spark, rows)).collect()
    want = Counter()
    for d, t, *_ in rows:
        s = brute_statistics(t)
        want[(d, *s, s[0] < 50 or 100 * s[4] > 50 * s[0])] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert not any(r["kept"] for r in got if r["base_failed"])
    assert outliers.judge(documents(spark, [])).count() == 0


def test_outliers_are_rejected(spark):
    rng = random.Random(3)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(60, 400))), "en", "a") for i in range(300)]
    rows += [(1000 + i, " ".join(x + "%%&&" for x in rng.choices(vocabulary, k=100)), "en", "a") for i in range(60)]
    got = {r["doc_id"]: r for r in outliers.judge(documents(spark, rows)).collect()}
    assert not any(got[1000 + i]["kept"] for i in range(60))  # a sixth of the rows doesn't mask itself
    good = [got[i] for i in range(300) if not got[i]["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)


def brute_mcd(x):
    """The estimate of one group by plain numpy: quartiles, concentration steps on the nearest half (the last bin of distances in part), reweighting."""
    floor = np.array(list(outliers.FLOOR.values()))

    def at_share(values, weights, share):
        order = np.argsort(values, kind="stable")
        return values[order][np.searchsorted(np.cumsum(weights[order]), math.ceil(share * weights.sum() - 1e-9))]

    grid, one = np.floor(x * 256 + 0.5), np.ones(len(x))
    q = np.array([[at_share(grid[:, j], one, s) for j in range(5)] for s in (0.25, 0.5, 0.75)]) / 256
    mean, cov = q[1], np.diag(np.maximum((q[2] - q[0]) / 1.349, floor) ** 2)
    far = lambda: np.einsum("ij,ij->i", x - mean, np.linalg.solve(cov, (x - mean).T).T)

    def estimate(w, factor):
        m = (w[:, None] * x).sum(0) / w.sum()
        return m, ((w[:, None] * x).T @ x / w.sum() - np.outer(m, m)) * factor + np.diag(floor**2)

    last = None
    while True:
        bins = np.floor(np.log2(far() + 1e-6) * 16)
        cut = at_share(bins, one, outliers.SHARE)
        need = math.ceil(outliers.SHARE * len(x)) - (bins < cut).sum()
        mean, cov = estimate(np.where(bins < cut, 1.0, np.where(bins == cut, need / (bins == cut).sum(), 0.0)), outliers.CONSISTENT)
        now = np.linalg.slogdet(cov)[1]
        if last is not None and last - now <= outliers.SETTLED:
            break
        last = now
    mean, cov = estimate((far() <= outliers.REWEIGHT).astype(float), outliers.REWEIGHTED)
    return far()


def test_distances_against_numpy(spark):
    """Two groups with their own estimates, and groups of few documents pooled by language or all together."""
    rng = random.Random(11)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    text = lambda: "\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(5, 30))) + rng.choice(["", " #", " $ %"]) for _ in range(rng.randint(4, 12)))
    rows = [(i, text(), "en", "ab"[i % 2]) for i in range(160)] + [(300 + i, text(), "de", f"s{i % 4}") for i in range(80)] + [(500 + i, text(), f"l{i % 5}", None) for i in range(60)]
    got = {r["doc_id"]: r for r in outliers.judge(documents(spark, rows)).collect()}
    groups = {}
    for d, t, lang, source in rows:
        n, chars, symbols, dup, repeat = brute_statistics(t)
        if got[d]["base_failed"]:
            assert got[d]["distance"] is None
            continue
        x = (math.log1p(n), math.log(chars / n), math.log1p(10 * symbols / n), dup / len(t.split("\n")), repeat / n)
        groups.setdefault((lang, source) if lang == "en" else lang if lang == "de" else "rest", []).append((d, x))
    for members in groups.values():
        want = brute_mcd(np.array([x for _, x in members]))
        assert len(members) >= outliers.LEAST
        assert np.allclose([got[d]["distance"] ** 2 for d, _ in members], want, rtol=1e-3)
        assert [got[d]["kept"] for d, _ in members] == [bool(w <= outliers.CUT) for w in want]


def test_salted_join_gives_the_same(spark, corpus, mixed, monkeypatch):
    docs = documents(spark, corpus)
    want = Counter(map(str, outliers.judge(docs).collect()))
    monkeypatch.setattr(common, "BROADCAST_KEYS", 0)
    assert Counter(map(str, outliers.judge(docs).collect())) == want
    assert Counter(map(str, mixing.mix(docs).collect())) == Counter(map(str, mixed))


@pytest.mark.parametrize("kind", ["copies", "scattered"])
def test_a_third_of_junk_does_not_mask_itself(spark, kind):
    rng = random.Random(5)
    vocabulary = [a + b for a in WORDS for b in WORDS]
    junk = lambda: " ".join(x + "%%&&" for x in rng.choices(vocabulary, k=rng.randint(80, 120)))
    one = junk()
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(60, 400))), "en", "a") for i in range(200)]
    rows += [(1000 + i, one if kind == "copies" else junk(), "en", "a") for i in range(100)]
    got = {r["doc_id"]: r for r in outliers.judge(documents(spark, rows)).collect()}
    assert not any(got[1000 + i]["kept"] for i in range(100))
    good = [got[i] for i in range(200) if not got[i]["base_failed"]]
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)


# op7


def test_quality(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, 60) if i % 3 else " ".join(w.upper() + "!!" for w in prose(rng, 60).split()), "en", "a") for i in range(600)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(600)] + [(None, 1, 0), (5000, None, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in zstdclass.classify(documents(spark, rows), labels).collect()}
    held = [r for r in got.values() if r["held_out"]]
    assert 100 < len(held) < 200
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in held]) > 0.95
    odd = zstdclass.classify(documents(spark, ODD), labels).collect()
    assert len(odd) == len(ODD) and all(0 <= r["score"] <= 1 for r in odd)
    assert all(r["score"] == 0.5 for r in zstdclass.classify(documents(spark, ODD), labels.limit(0)).collect())
    assert zstdclass.classify(documents(spark, []), labels).count() == 0


def test_scores_against_zstandard(spark):
    """Whole labelled texts of 100 KB, repeated and contradicting labels; each score is the logistic of the size difference over all pieces."""
    import zstandard

    rng = random.Random(6)
    rows = [(i, prose(rng, 40) if i % 2 else prose(rng, 40).upper() + " !!", "en", "a") for i in range(200)]
    rows += [(200, "tail " * 2 + prose(rng, 20_000), "en", "a"), (201, prose(rng, 60), "en", "a")]
    labels = [(i, i % 2, 0) for i in range(200)] + [(7, 1, 0), (200, 1, 0), (201, 0, 0), (201, 1, 0), (999, 1, 0)]
    docs, said = documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = zstdclass.fit(docs, said)
    assert model.fitted and len(model.good) > 8 and len(model.bad) > 8

    def size(data, d):
        c = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_checksum=False, write_dict_id=False)
        return sum(len(c.compress(data[i : i + zstdclass.PIECE])) for i in range(0, len(data), zstdclass.PIECE))

    for r in zstdclass.classify(docs, said).collect():
        data = rows[r["doc_id"]][1].encode()
        x = (size(data, model.bad) - size(data, model.good)) / len(data)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-(model.weights[0] + model.weights[1] * x))), abs=1e-9)
        assert r["predicted"] == (r["score"] >= 0.7)
    few = zstdclass.fit(docs, said.where("doc_id < 4"))
    assert 0 <= few.score(np.array([0.0]))[0] <= 1


# op8


def brute_fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x, seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("cell", [2048, 2])
def test_simhash(spark, corpus, cell):
    small = corpus
    got = simhash.near_duplicates(documents(spark, small), cell=cell).collect()
    assert len(got) == len(small)
    fps = sorted({brute_fingerprint(t) for _, t, *_ in small})
    label = dict(zip(fps, brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2), strict=True))
    least = {}
    for d, t, *_ in small:
        if d is not None:
            c = label[brute_fingerprint(t)]
            least[c] = min(least.get(c, 10**9), d)
    want = Counter((d, f"{brute_fingerprint(t):016x}", least.get(label[brute_fingerprint(t)])) for d, t, *_ in small)
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got) == want


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3)), min_size=1, max_size=60))
@settings(max_examples=50, deadline=None)
def test_verify_joins_all_within_two_bits(values):
    fps = sorted({v for base, flips in values for v in (base, *(base ^ (1 << b) for b in flips))})
    signed = np.array(fps, "u8").view("i8")
    edges = simhash.verify(signed, 2)
    at = {int(v): i for i, v in enumerate(signed)}
    joined = {(at[a], at[b]) for a, b in edges}
    assert all((fps[a] ^ fps[b]).bit_count() for a, b in joined)
    full = brute_components(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    got = brute_components(len(fps), lambda i, j: (i, j) in joined or (j, i) in joined)
    assert full == got


@given(st.integers(1, 4), st.lists(st.floats(0, 1e9), min_size=20, max_size=20))
@settings(max_examples=50, deadline=None)
def test_thresholds(parts, costs):
    cost = np.array(costs[: parts * 4]).reshape(parts, 4)
    t = simhash.allocate(cost, 2)
    assert sum(t) == 2 - parts + 1 and all(-1 <= x <= 2 for x in t)


def test_keep_one(spark, corpus):
    docs = documents(spark, corpus)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = {r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({i: 1 for i in ids})
    assert simhash.keep_one(documents(spark, [])).count() == 0


# op9


@pytest.fixture(scope="module")
def coder():
    return bpe.Bpe(RANKS, P.PATTERN), tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})


@given(st.one_of(st.text(max_size=300), st.text("abcdet 'sn1\n\té", max_size=900), st.integers(1, 1200).map(lambda n: "ab" * n), st.integers(1, 900).map(lambda n: " " * n + "x")))
@settings(max_examples=200, deadline=None)
def test_bpe_equals_library(coder, text):
    mine, lib = coder
    ids = next(iter(mine.encode_texts([text])))
    assert ids.tolist() == lib.encode_ordinary(text)
    assert mine.decode(ids) == text.encode()


def test_tokenize(spark, corpus, coder):
    got = bpe.tokenize(documents(spark, corpus), RANKS, P.PATTERN).collect()
    want = Counter()
    for d, t, *_ in corpus:
        ids = coder[1].encode_ordinary(t or "")
        want[d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert bpe.tokenize(documents(spark, []), RANKS, P.PATTERN).count() == 0


# op10


def test_language(spark, corpus):
    got = langid.identify(documents(spark, corpus)).collect()
    assert len(got) == len(corpus)
    lang = {d: x for d, _, x, _ in corpus}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 240]
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.95
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (1001, 1002, 1003, 1006)} == {"und"}
    assert by[1007]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify(documents(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(documents(spark, [(1, "text", None, "a")])).collect()} == {"und"}


def test_language_against_brute_force(spark, corpus):
    """Predictions are the language of the nearest centroid, from vectors made here with dictionaries; document frequencies count every learning document."""
    docs = documents(spark, corpus)
    model = langid.fit(docs, per_lang=20)
    learn = [t for d, t, lang, _ in corpus if d is not None and __import__("zlib").crc32(str(d).encode()) % 5 and lang is not None and t and any(c.isalpha() for c in t)]

    def grams(text):
        w = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower())) + " "
        c, m = Counter(), 1 << 32
        for i in range(len(w)):
            h = ord(w[i]) * 0x9E3779B1 % m
            c[h >> 19] += 1
            if i + 1 < len(w):
                two = (h ^ ord(w[i + 1]) * 0x85EBCA77 % m) * 0xC2B2AE3D % m
                c[two >> 19] += 1
                if i + 2 < len(w):
                    c[(two ^ ord(w[i + 2]) * 0x27D4EB2F % m) * 0x165667B1 % m >> 19] += 1
        return c

    df = Counter(k for t in learn for k in grams(t))
    assert np.allclose(model.idf, [math.log((len(learn) + 1) / (df[k] + 1)) + 0.05 for k in range(langid.DIMS)], atol=1e-5)
    got = {(r["doc_id"]): r["lang_pred"] for r in langid.with_language(docs.select("doc_id", "text"), model).collect()}
    for d, t, *_ in corpus[::7]:
        if t and any(c.isalpha() for c in t):
            v = {k: math.log1p(n) * model.idf[k] for k, n in grams(t).items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            sims = [sum(x * c[k] for k, x in v.items()) / norm for c in model.centroids]
            best = max(sims)
            near = {model.langs[model.lang_of[i]] for i, s in enumerate(sims) if s > best - 1e-5}
            assert got[d] in near


def test_every_language_is_learned(spark):
    rng = random.Random(9)
    rows = []
    for i in range(1200):
        a, b = chr(0x4E00 + 2 * i), chr(0x4E01 + 2 * i)
        rows += [(3 * i + k, " ".join(rng.choice((a, b)) * rng.randint(1, 3) for _ in range(30)), f"lang{i}", "s") for k in range(3)]
    model = langid.fit(documents(spark, rows), most=2000)
    held = [lang for d, _, lang, _ in rows if __import__("zlib").crc32(str(d).encode()) % 5]
    assert set(model.langs) == set(held)
