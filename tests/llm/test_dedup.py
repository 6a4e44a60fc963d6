from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import words
from tidemark.llm import shared, simhash, substrings, suffixes, vectors


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 260)] + [(300 + i, 300 + (i + 1) % 20) for i in range(20)] + [(rng.randrange(400, 440), rng.randrange(400, 440)) for _ in range(40)]
    found = {r.node: r.root for r in shared.components(spark.createDataFrame(edges, "u long, v long").repartition(7)).collect()}
    expected = brute.components({x for e in edges for x in e}, edges)
    assert {n: found.get(n, n) for n in expected} == expected
    assert shared.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_golay_covering():
    first, many, patterns = simhash.covering()
    weights = np.bitwise_count(patterns)
    assert len(first) == 2048 and (weights[first] <= 3).all() and many.sum() == sum(__import__("math").comb(23, w) for w in range(5))
    assert all((weights[f + 1 : f + m] == 4).all() for f, m in zip(first, many, strict=True))


def test_simhash_contract(spark, sf, corpus):
    found = {r.doc_id: r for r in simhash.op4_simhash(spark, sf).collect()}
    some = sorted(corpus)[::7]
    assert all(found[i].fingerprint == f"{brute.simhash(corpus[i], 3):016x}" for i in some)
    ids = sorted(found)
    fps = np.array([int(found[i].fingerprint, 16) for i in ids], np.uint64)
    links = [(ids[a], ids[b]) for a in range(len(ids)) for b in np.flatnonzero(np.bitwise_count(fps[a] ^ fps[a + 1 :]) <= 3) + a + 1]
    assert {i: found[i].component_id for i in ids} == brute.components(ids, links)


def test_anchors_lose_no_link(spark):
    """All pairs at 0 ... 5 bits around some fingerprints, and random ones, with anchors split as if hot."""
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**64, 12, dtype=np.uint64)
    fps = {int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)}
    for x in base:
        for n in range(6):
            for _ in range(12):
                fps.add(int(x) ^ sum(1 << int(b) for b in rng.choice(64, n, replace=False)))
    fps = np.array(sorted(fps), np.uint64)
    nodes = spark.createDataFrame([(int(f.astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    links = [(a, int(b)) for a in range(len(fps)) for b in np.flatnonzero(np.bitwise_count(fps[a] ^ fps[a + 1 :]) <= 3) + a + 1]
    expected = brute.components(range(len(fps)), links)
    for hot in (simhash.HOT_HOMES, 2):
        before, simhash.HOT_HOMES = simhash.HOT_HOMES, hot
        try:
            roots = {r.node: r.root for r in shared.components(simhash.link(nodes)).collect()}
        finally:
            simhash.HOT_HOMES = before
        assert {n: roots.get(n, n) for n in expected} == expected


def test_simhash_odd_rows(spark, odd, odd_rows, empty):
    found = simhash.near_duplicates(odd.withColumn("fp", F.lit("x")), 3).collect()
    assert len(found) == len(odd_rows)
    assert sorted((r.fp & (2**64 - 1)) for r in found) == sorted(brute.simhash(t, 3) for _, t, *_ in odd_rows)
    by = {r.doc_id: r.component_id for r in found}
    assert by[1] == by[2] == by[None] == 1 and by[4] == by[5] == by[6] == 4 and by[12] == 12
    assert simhash.near_duplicates(empty).count() == 0


def test_one_of_each_keeps_one_of_near_copies(spark, odd, empty):
    alone = odd.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a text of its own without any id").alias("text"), "lang", "source", "n_chars")
    left = [r.doc_id for r in simhash.one_of_each(odd.union(alone).union(alone)).collect()]
    assert sorted(left, key=str) == sorted([1, 4, 7, 8, 9, 10, 11, 12, 14, 15, None], key=str)
    assert simhash.one_of_each(empty).columns == empty.columns and simhash.one_of_each(empty).count() == 0


def test_near_copies_by_similarity(spark):
    """Copies with 1 % of words changed (similarity about 0.9) are caught, other texts of the same words are not."""
    rng = random.Random(5)
    rows, k = [], 0
    for group in range(30):
        text = words(rng, 250, 3000).split(" ")
        for copy in range(4):
            mine = list(text)
            for _ in range(3 if copy else 0):
                mine[rng.randrange(250)] = f"other{rng.randrange(999)}"
            rows.append((k, " ".join(mine), group))
            k += 1
    found = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string, g int")).collect()
    roots = {r.doc_id: r.component_id for r in found}
    assert all(roots[i] // 4 == i // 4 for i in roots)
    assert sum(roots[i] == i // 4 * 4 for i in roots) >= 0.97 * len(roots)


@pytest.mark.parametrize("edit", ["appended", "block", "scattered"])
def test_near_copies_by_exact_similarity(spark, edit):
    """Copies are linked just if the Jaccard similarity of their five-word shingles is 0.8 or more, whatever the edit."""
    rng = random.Random(6)
    line = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shingles = lambda x: {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    rows, alike = [], []
    for k in range(150):
        text = line(rng.randrange(100, 400))
        n, at = round(len(text) * rng.uniform(0.02, 0.3)), rng.randrange(len(text) // 2)
        if edit == "appended":
            copy = text + line(n)
        elif edit == "block":
            copy = text[:at] + line(n // 2) + text[at + n // 2 :]
        else:
            copy = [w if rng.random() > n / len(text) / 6 else "new" for w in text]
        a, b = shingles(text), shingles(copy)
        alike.append(len(a & b) >= 0.8 * len(a | b))
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    assert 20 < sum(alike) < 150
    roots = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [roots[2 * k + 1] == 2 * k for k in range(150)] == alike and all(roots[2 * k] == 2 * k for k in range(150))


def test_suffixes_contract(spark, odd_rows, empty):
    rng = random.Random(9)
    passage = words(rng, 40)
    rows = [(i, " ".join([words(rng, rng.randrange(30)), passage[: rng.randrange(40, 240)], words(rng, rng.randrange(30))])) for i in range(20, 60)]
    rows += [(i, t) for i, t, *_ in odd_rows if i not in (None, 9, 10, 12)] + [(9, words(rng, 3000) + passage), (60, "z" * 49), (61, "z" * 50), (62, "z" * 49), (63, "z" * 51), (64, "é" * 60), (65, "xé" + "é" * 30)]
    masks = brute.removed(rows)
    texts = dict(rows)
    found = suffixes.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).repartition(5)).collect()
    assert len(found) == len(rows)
    for r in found:
        mask = masks[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(mask), sum(mask), len(mask.replace(b"\0", b" ").split()), brute.kept_sha(texts[r.doc_id], mask)), r.doc_id
    assert suffixes.deduplicate(empty).count() == 0


def test_suffixes_sql(spark, sf):
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
        found = c.execute(suffixes.OP3_SQL)
        names, expected = [d[0] for d in found.description], sorted(found.fetchall())
    got = suffixes.op3_suffixes(spark, sf).select(*names).collect()
    assert sorted(map(tuple, got)) == expected and sum(r.n_removed > 0 for r in got) > 10


def test_suffixes_rows_without_id_and_repeated_rows(spark):
    text = words(random.Random(2), 60)
    found = suffixes.deduplicate(spark.createDataFrame([(5, text), (5, text), (None, text), (7, text)], "doc_id long, text string")).collect()
    n = len(text.encode())
    assert sorted((str(r.doc_id), r.n_removed) for r in found) == [("5", 0), ("5", 0), ("7", n), ("None", n)]


def test_multikey_order():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 3, (500, 6)).astype(np.uint64)
    order = suffixes.multikey_order(w)
    assert [tuple(r) for r in w[order].tolist()] == sorted(tuple(r) for r in w.tolist())


def _sentences(text):
    out, now = [], []
    tokens = [(m.group(), m.start(), m.end()) for m in brute.WORD.finditer(text or "")]
    for k, (w, _, end) in enumerate(tokens):
        now.append(w.translate(brute.LOWER))
        if w[-1] in ".!?" or k + 1 == len(tokens) or "\n" in text[end : tokens[k + 1][1]]:
            out.append(tuple(now))
            now = []
    return out


def test_sentence_spans(spark):
    rng = random.Random(8)
    line = lambda: " ".join(f"v{rng.randrange(999)}" for _ in range(rng.randrange(4, 12))) + rng.choice([".", "!", "\n", "?"])
    passage = [line() for _ in range(7)]
    rows = [(i, " ".join([*(line() for _ in range(rng.randrange(5))), *(passage if i % 3 else []), *(line() for _ in range(rng.randrange(5)))])) for i in range(40)]
    rows += [(40, None), (41, ""), (42, " \n"), (43, "one two."), (44, rows[1][1]), (45, rows[3][1])]
    first, spans = {}, {}
    for i, text in rows:
        s = _sentences(text)
        short = lambda a, b: b - a < substrings.SENTENCES or sum(map(len, s[a:b])) < substrings.LEAST_WORDS  # noqa: E731, B023
        every = {(a, next((b for b in range(a + 1, len(s) + 1) if not short(a, b)), None)) for a in range(len(s))}
        every |= {(next((a for a in range(b - 1, -1, -1) if not short(a, b)), None), b) for b in range(1, len(s) + 1)}
        for a, b in sorted(x for x in every if None not in x):
            key = sum(s[a:b], ())
            first.setdefault(key, (i, a))
            spans.setdefault(i, []).append((key, a, b))
    found = {r.doc_id: r for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    assert len(found) == len(rows)
    for i, text in rows:
        gone = {x for key, a, b in spans.get(i, []) if first[key] != (i, a) for x in range(a, b)}
        s = _sentences(text)
        assert (found[i].n_sentences, found[i].n_removed) == (len(s), len(gone)), i
        assert brute.WORD.findall((found[i].text or "").translate(brute.LOWER)) == [w for k, x in enumerate(s) if k not in gone for w in x]
    assert found[40].text is None and found[42].text == " \n" and found[44].n_removed == found[44].n_sentences


@pytest.mark.parametrize("shape", ["two sentences", "inside sentences", "one sentence"])
def test_passages_of_few_sentences(spark, shape):
    """Passages of 51 to 64 words that hold less than three whole sentences go from all copies but the first, nothing else does."""
    rng = random.Random(9)
    line = lambda n: " ".join(f"v{rng.randrange(10**6)}" for _ in range(n))
    rows, later, alone = [], set(), set()
    for k in range(60):
        sizes = {"two sentences": (rng.randrange(26, 33), rng.randrange(26, 33)), "inside sentences": (rng.randrange(1, 20), rng.randrange(20, 32)), "one sentence": (51,)}[shape]
        passage = ". ".join(line(n) for n in sizes)
        if shape == "inside sentences":
            passage += ". " + line(max(1, 51 - sum(sizes)))
        dot = "." if shape == "two sentences" else ""
        for copy in range(2):
            around = [line(rng.randrange(1, 31)) + dot for _ in range(2)]
            rows.append((2 * k + copy, f"{line(9)}. {around[0]} {passage}{dot} {around[1]}. {line(9)}."))
            (later if copy else alone).add(2 * k + copy)
    found = {r.doc_id: r for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert not [i for i in later if not found[i].n_removed] and not [i for i in alone if found[i].n_removed]
    for i in later:
        gone = len(rows[i][1].split()) - len(found[i].text.split())
        assert 51 - 2 * (substrings.WINDOW - 1) <= gone <= 64, i


def test_passages_of_other_scripts(spark):
    """Sentences end with stops of other scripts, and texts without spaces are cut, too."""
    rng = random.Random(3)
    chars = lambda a, n: "".join(chr(a + rng.randrange(80)) for _ in range(n))
    shapes = {
        "chinese": lambda: "。".join(chars(0x4E00, rng.randrange(6, 14)) for _ in range(8)) + "。", "thai": lambda: chars(0x0E01, 90)[:90].replace("\u0e3b", "ก"), "rare": lambda: chars(0x20000, 70),
        "arabic": lambda: " ".join(chars(0x0628, 4) for _ in range(5)) + "؟ " + " ".join(chars(0x0628, 4) for _ in range(6)) + "؟ " + " ".join(chars(0x0628, 4) for _ in range(7)) + "؟",
    }
    rows, later = [], []
    for make in shapes.values():
        for _ in range(5):
            passage = make()
            rows += [(len(rows), f"{make()} {passage} {make()}"), (len(rows) + 1, f"{make()} {passage} {make()}")]
            later.append((len(rows) - 1, passage))
    rows.append((len(rows), rows[0][1]))
    found = {r.doc_id: r for r in substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    short = [(i, len(passage), len(rows[i][1]) - len(found[i].text)) for i, passage in later if len(rows[i][1]) - len(found[i].text) < 0.4 * len(passage)]
    assert not short
    assert not any(found[i].n_removed for i in range(0, len(rows) - 1, 2)) and found[len(rows) - 1].text == ""


@pytest.mark.parametrize("parts", [1, 6])
def test_span_ids_have_no_sentinel(spark, parts):
    """The largest doc_id is like any other; texts of one doc_id are documents of their own however rows are dealt out."""
    rng = random.Random(2)
    passage, other = words(rng, 60, 10**6), words(rng, 30, 10**6)
    rows = [(2**63 - 1, passage), (None, passage), (5, passage), (7, f"{passage}. {other}"), (7, f"{passage}. {other} more")]
    found = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)).collect()
    assert sorted((str(r.doc_id), r.n_removed == r.n_sentences, r.n_removed > 0) for r in found if r.doc_id != 7) == [("5", False, False), (str(2**63 - 1), True, True), ("None", True, True)]
    left = [len(r.text.split()) for r in found if r.doc_id == 7]
    assert len(left) == 2 and min(left) <= 20 < max(left) < 60


def test_sentence_spans_odd_rows(spark, odd, odd_rows, empty):
    found = substrings.deduplicate(odd.withColumn("span", F.lit(1))).collect()
    assert len(found) == len(odd_rows)
    by = {r.doc_id: r for r in found}
    assert by[1].n_removed == 0 and by[2].n_removed == by[2].n_sentences and by[None].n_removed == by[None].n_sentences and by[14].n_removed == 0
    assert substrings.deduplicate(empty).count() == 0


@pytest.fixture
def clustered():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(60, 16))
    rows = [(i, (base[i % 60] + rng.normal(scale=rng.choice([0.02, 0.2, 0.35]), size=16)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[7][1]) for i in range(30)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [float("nan")] * 16), (3003, [1.0] * 15 + [None]), (3004, []), (3005, [float("inf")] + [1.0] * 15), (3006, [1.0, 2.0]), (3007, [2.0, 4.1]), (3008, [1e-30] * 16), (3009, [1e30] * 16), (5, rows[5][1])]
    return rows


def test_vectors_against_brute_force(spark, clustered):
    df = spark.createDataFrame(clustered, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).repartition(5)
    for most in (vectors.MOST_MEMBERS, 100):
        before = vectors.MOST_MEMBERS, vectors.MOST_QUERIES
        vectors.MOST_MEMBERS = vectors.MOST_QUERIES = most
        try:
            found = vectors.near_duplicates(df).collect()
        finally:
            vectors.MOST_MEMBERS, vectors.MOST_QUERIES = before
        assert len(found) == len(clustered)
        got = {r.vec_id: r for r in found}
        rows = {i: np.array(v, float) for i, v in clustered if v and None not in v and np.isfinite(v).all() and np.any(v)}
        links = {i: 0 for i in got}
        pairs = []
        ids = sorted(rows)
        for width in {len(v) for v in rows.values()}:
            mine = [i for i in ids if len(rows[i]) == width]
            x = np.array([rows[i] / np.linalg.norm(rows[i]) for i in mine])
            for a, b in zip(*np.nonzero(np.triu(x @ x.T >= 0.9, 1)), strict=True):
                pairs.append((mine[a], mine[b]))
                links[mine[a]] += 1
                links[mine[b]] += 1
        assert all(got[i].n_links <= links[i] for i in got)
        assert sum(r.n_links for r in got.values()) >= 0.99 * sum(links.values())
        roots = brute.components(got, pairs)
        assert sum(got[i].component_id != roots[i] for i in got) <= 0.01 * len(got)
        assert all(r.kept == (r.component_id == r.vec_id) for r in got.values()) and got[3000].n_links == 0 and got[3007].n_links == 1


def test_vectors_of_any_length(spark):
    """Norms neither overflow nor vanish: cosines of huge and tiny vectors count like any other."""
    rows = [(1, [1.7e308] * 4), (2, [1e308] * 4), (3, [5e-324] * 4), (4, [1.0, 1.0, 1.0, 0.9]), (5, [-1e308] * 4), (6, [0.0, 0.0, 0.0, 1e-320]), (None, [1.0] * 4)]
    found = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("key", F.lit("x"))).collect()}
    assert {i: (r.n_links, r.component_id) for i, r in found.items()} == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), None: (0, None)}


def test_vectors_none_sound(spark):
    found = vectors.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0])], "vec_id long, embedding array<float>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in found} == {(1, 0, 1, True), (2, 0, 2, True)}
    assert vectors.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
