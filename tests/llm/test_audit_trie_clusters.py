"""The filter audit, the trie encoder and the clusters against brute force, the tokenizer's library and odd rows."""

import hashlib
import math
import random
import re
from array import array
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyworks.llm import clustering, common, filter_audit, queries, trie_bpe

SF = "/root/testdata/sf0.001"
JSON = "byte_bpe_50k.json"
GOOD = " ".join(f"word{i}" for i in range(120))
ODD = [
    (1, "", "en"), (2, None, None), (3, None, "en"), (4, GOOD, "en"), (5, GOOD, "de"), (5, GOOD, "de"), (6, GOOD, None), (7, "a " * 300, "en"), (8, "ABCDE " * 40 + "|", "en"), (9, GOOD + " 5%", "fr"),
    (10, "\x1c\x85 odd  \n\n white\tspace <|endoftext|>x<|endoftext|>  ", "en"), (11, "w" * 5000, "en"), (12, "日本語 😀 Ünïcode — ́ end. don't we'll", "de"), (13, "say it again. " * 4000, "en"), (14, "Say" + " " * 3000 + "-" * 3000, "en"),
    (None, GOOD, "en"), (None, "no id", "de"), (2**53 + 1, "a large id", "en"), (2**63 - 1, "a large id", "en"), (0, "a large id", "fr"),
]
MARKS = [(4, 1, 0), (5, 1, 1), (5, 0, None), (7, None, 1), (9, 1, 0), (13, 0, 1), (None, 1, 1), (77, 1, 1), (2**63 - 1, 1, 0)]


@pytest.fixture(scope="module")
def odd(spark):
    common.ship(spark)
    return spark.createDataFrame(ODD, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("part", "n", "fails", "digest", "good", "toxic", "quality", "ids", "passing")})


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame(MARKS, "doc_id long, quality int, toxic int").withColumns({c: F.lit(9) for c in ("part", "n", "digest", "text")})


def audited(docs, labels):
    """Each document goes through each order, one by one."""
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    first = {}
    for d, t, _ in docs:
        if d is not None:
            first[t or ""] = min(d, first.get(t or "", d))
    good, toxic = ({d for d, *m in labels if d is not None and m[k] == 1} for k in (0, 1))
    out = Counter()
    parts = set()
    for d, t, lang in docs:
        t, part = t or "", lang or ""
        w = words(t)
        failing = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and first[t] < d,
        }
        parts.add(part)
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                key = part, order, step
                out[(*key, "redundant")] += failing[f] and gone
                out[(*key, "unique_fails")] += failing[f] and sum(failing.values()) == 1
                removed = failing[f] and not gone
                out[(*key, "removed")] += removed
                out[(*key, "good_lost")] += removed and d in good
                out[(*key, "toxic_lost")] += removed and d in toxic
                out[(part, f)] += removed
                gone |= failing[f]
                out[(*key, "kept")] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((p, o, s, *(out[(p, o, s, n)] for n in names), out[(p, o[s - 1])]) for p in parts for o in map("".join, permutations("ABCDE")) for s in range(1, 6))


def test_audit_is_that_of_each_document(spark, odd, marks):
    want = audited(ODD, MARKS)
    assert sorted(map(tuple, filter_audit.audit(odd, marks).collect())) == want
    assert {r[0] for r in want} == {"", "en", "de", "fr"} and any(r[-1] for r in want)


def test_audit_of_a_table_and_of_none(spark, odd, marks):
    common.ship(spark)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = lambda df, *cs: [tuple(r) for r in df.select(*cs).collect()]
    want = audited(rows(docs, "doc_id", "text", "lang"), rows(labels, "doc_id", "quality", "toxic"))
    assert sorted(map(tuple, queries.op11_filter_audit(spark, SF).collect())) == want
    assert filter_audit.audit(odd.limit(0), marks).count() == 0
    assert filter_audit.audit(odd, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_audit_needs_no_task_for_all_copies(spark, marks):
    """Before rows of a text meet, each task has reduced its copies to one."""
    copies = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.lit(GOOD).alias("text"), F.lit("en").alias("lang"))
    rows = common.staged(filter_audit.measured(copies, marks), "measured-test")
    steps = filter_audit.audit_of(filter_audit.patterns(rows).toPandas()).query("filter_order == 'EABCD' and step == 1").iloc[0]
    assert (steps["kept"], steps["removed"]) == (1, 19_999)
    plan = filter_audit.patterns(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(common.tokenizer_file(JSON))
    t.no_truncation()
    t.no_padding()
    return t


def test_trie_gives_the_library_s_ids_and_texts(spark, odd, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    for df in (docs, odd):
        want = []
        for d, t in df.select("doc_id", "text").collect():
            ids = library.encode(t or "", add_special_tokens=False).ids
            want.append((d, len(ids), sha(array("I", ids).tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
        got = map(tuple, trie_bpe.digest(df, JSON).collect())
        assert sorted(got, key=repr) == sorted(want, key=repr)
    encoded = trie_bpe.encode(odd, JSON)
    assert sorted(((r["doc_id"], r["text"]) for r in trie_bpe.decode(encoded, JSON).collect()), key=repr) == sorted(((d, t or "") for d, t, _ in ODD), key=repr)
    assert trie_bpe.digest(odd.limit(0), JSON).count() == trie_bpe.encode(odd.limit(0), JSON).count() == 0


def test_trie_on_mixed_signs(library, monkeypatch):
    rnd = random.Random(7)
    signs = [*"ab  \n\t\r\x0b\x1c\x85　'st<|>é日本😀=-_12", "<|endoftext|>", "՘", "֋", " the", "'ll"]
    texts = ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(4000)]
    monkeypatch.setattr(trie_bpe.Trie, "LIMIT", 500)  # forgets again and again
    monkeypatch.setattr(trie_bpe.Trie, "STRETCHES", 900)
    trie = trie_bpe.Trie(JSON)
    for low in range(0, len(texts), 400):
        for t, ids in zip(texts[low : low + 400], trie.encode_batch(texts[low : low + 400])):
            assert list(array("I", ids)) == library.encode(t, add_special_tokens=False).ids, t


def test_every_token_is_its_own_encoding_and_prefixes_are_shared():
    trie = trie_bpe.Trie(JSON)
    ends = trie.insert(trie.vocab)
    assert all(trie_bpe._read(trie.last, trie.back, ends[s]) == [i] for s, i in trie.vocab.items())
    assert len(trie.last) - 1 == len({s[:k] for s in trie.vocab for k in range(1, len(s) + 1)})
    nodes = len(trie.last)
    trie.insert([b" theologically", b" theologian"])
    added = len(trie.last) - nodes
    trie.insert([b" theologically", b" theologian"])
    assert len(trie.last) == nodes + added


def test_trie_on_long_words(library):
    trie = trie_bpe.Trie(JSON)
    for t in (" " * 50_000, "w" * 50_000, "-" * 30_000, "ab=" * 20_000, "日" * 10_000):
        assert list(array("I", trie.encode_batch([t])[0])) == library.encode(t, add_special_tokens=False).ids
    assert len(trie.last) < 10


def clustered(rows, k, rounds, size):
    """In plain Python: (vec_id, cluster, distance) of all that take part, and the centroids."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in hashed]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for _, v in kept:
            members[near(v)[1]].append(v)
        centroids = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, centroids)]
    found = [(i, *near(v)[::-1]) for i, v in kept]
    return found, [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]


def as_rows(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def expected(rows, k, rounds, size):
    found, names = clustered(rows, k, rounds, size)
    per = Counter()
    for _, c, d in found:
        per[c] += d
    return sorted(((i, c, d, per[c], sum(per.values()), names[c]) for i, c, d in found), key=repr)


def test_clusters_are_those_of_every_distance(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert as_rows(queries.op13_clusters(spark, SF)) == expected(rows, 40, 5, 64)


def test_clusters_of_odd_vectors_and_ties(spark):
    rnd = random.Random(3)
    grid = [(i, [rnd.choice((-1.5, 0.0, 0.25, 1.0)) for _ in range(3)]) for i in range(300)]
    rows = [*grid, *grid[:50], (None, [0.1, 0.2, 0.3]), (400, None), (401, []), (402, [1.0, 2.0]), (403, [1.0, None, 2.0]), (404, [math.nan, 0.0, 0.0]), (405, [math.inf, 0.0, 0.0]), (2**63 - 1, [0.0, 0.0, 0.0]), (406, [1e5, -1e5, 3.0]), (7, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "cluster", "distance", "label", "s", "n")})
    for k, rounds in ((40, 5), (7, 2), (1, 1), (500, 1)):
        assert as_rows(clustering.clusters(df, k, rounds, size=3)) == expected(rows, k, rounds, 3)
    assert clustering.clusters(df.limit(0), size=3).count() == 0
    assert clustering.clusters(df.where("vec_id = 400"), size=3).count() == 0
    few = df.where("vec_id < 3")
    assert as_rows(clustering.clusters(few, size=3)) == expected([r for r in rows if r[0] is not None and r[0] < 3], 40, 5, 3)


def test_components_too_large_end_the_job(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="when scaled"):
        clustering.clusters(df, size=2)


def test_tree_search_is_exact_and_leaves_nodes_out(monkeypatch):
    rnd = np.random.default_rng(5)
    centres = rnd.integers(-2000, 2000, (40, 8))
    centroids = np.concatenate([centres, centres[:5]])  # ties between equal ones
    vectors = centres[rnd.integers(0, 40, 5000)] + rnd.integers(-60, 60, (5000, 8))
    all_distances = ((vectors[:, None, :] - centroids[None]) ** 2).sum(2)
    measured = []
    plain = clustering.distances
    monkeypatch.setattr(clustering, "distances", lambda v, c: measured.append(len(v)) or plain(v, c))
    tree = clustering.Tree(centroids)
    measured.clear()
    number, best = tree.nearest(vectors)
    assert (number == all_distances.argmin(1)).all() and (best == all_distances.min(1)).all()
    assert sum(measured) < 0.6 * len(vectors) * len(centroids)
