"""Exact, line and near-duplicate operators against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstone.llm import exact_dup, line_dup, near_dup
from quillstone.llm.common import connected_components

LOWER = {c: c + 32 for c in range(65, 91)}


def folded(text):
    return (text or "").translate(LOWER)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for x in {v for a, b in edges if a != b for v in (a, b)}}
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


TEXTS = ["abc", "ABC", "aBcd", "", None, "É", "é", "x" * 100, "X" * 100, "x" * 99 + "y", "ab" * 40, "ab" * 41, "line\nline", "ab" * 40]


def exact_want(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(folded(t), []).append(i)
    return sorted((i, max(groups[folded(t)]), len(groups[folded(t)]), i == max(groups[folded(t)]), hashlib.sha256(folded(t).encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("digest", [None, "weak"])
def test_exact_matches_brute_force(docs, digest):
    rows = list(enumerate(TEXTS))
    options = {"digest": lambda b: F.unhex(F.substring(F.md5(b), 1, 2))} if digest else {}
    if digest:  # one byte of digest: different blocks collide, and names return by bytes
        rows += [(100 + i, f"text {i} " * (i % 9 + 1)) for i in range(60)]
    got = sorted(map(tuple, exact_dup.exact_duplicates(docs(rows, extra=True), block_bytes=8, **options).collect()))
    assert got == exact_want(rows)


def test_exact_edges(docs):
    assert exact_dup.exact_duplicates(docs([])).count() == 0
    got = exact_dup.exact_duplicates(docs([(None, "a"), (3, "a"), (3, "a"), (None, "b")])).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in got) == [("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True)]


def lines_want(rows):
    first, gone = {}, {}
    places = [(i, p) for i, t in sorted(rows) for p in range(len((t or "").split("\n")) - 2)]
    text = dict(rows)
    for i, p in places:
        w = tuple((text[i] or "").split("\n")[p : p + 3])
        if not "".join(w).strip():
            continue
        if w not in first:
            first[w] = (i, p)
            continue
        j, q = first[w]
        for k in range(max(p, q + 3) if i == j else p, p + 3):
            gone.setdefault(i, set()).add(k)
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in rows}


def test_lines_match_brute_force(docs):
    rng = random.Random(7)
    rows = [(i, "\n".join(rng.choice(["a", "b", "", " ", "c"]) for _ in range(rng.randint(1, 12)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "q\nq\nq\nq\nq\nq"), (103, "long\n" * 3000), (104, "one\ntwo")]
    got = line_dup.deduplicate_lines(docs(rows, extra=True))
    assert {r["doc_id"]: r["text"] for r in got.collect()} == lines_want(rows)
    assert "key" in got.columns and line_dup.deduplicate_lines(docs([])).count() == 0


def test_lines_treat_repeated_rows_alike(docs):
    got = line_dup.deduplicate_lines(docs([(1, "a\nb\nc"), (1, "a\nb\nc"), (None, "a\nb\nc"), (2, "a\nb\nc\nd")])).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == [("1", ""), ("1", ""), ("2", "d"), ("None", "a\nb\nc")]


def shingle_set(text, width=5):
    """By definition: runs of words, as tuples."""
    words = re.findall(r"[^\x20\x09-\x0D]+", folded(text))
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, min(len(words), 1)))}


def near_want(rows):
    sets = {i: shingle_set(t or "") for i, t in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            both = len(sets[i] & sets[j])
            if i < j and sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def copies(rng, n, words=60):
    """Texts of which many are edited copies, near the threshold on both sides."""
    rows = []
    vocabulary = [f"w{i}" for i in range(300)]
    for base in range(n // 10):
        text = [rng.choice(vocabulary) for _ in range(words)]
        for k in range(10):
            own = list(text)
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((base * 10 + k, " ".join(own)))
    return rows


EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "two words"), (904, "Two  WORDS"), (905, "three little words"), (906, "a b c d e"), (907, "a b c d e f"), (908, "é É x y z"), (909, "w " * 9000), (910, "w w w w w w")]


def check_near(docs, rows, **options):
    got = near_dup.near_duplicates(docs(rows, extra=True), **options)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got.collect()} == near_want(rows)


def test_near_matches_brute_force(docs):
    check_near(docs, copies(random.Random(5), 120) + EDGES)


def test_near_with_heavy_nodes(docs):
    """Nodes far over their weight: deep branching, pivots and block pairs."""
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(80))
    rows = copies(rng, 60) + [(200 + i, passage + " " + " ".join(f"u{i}x{k}" for k in range(rng.randint(3, 30)))) for i in range(60)]
    check_near(docs, rows, node_weight=400, depth=2)


def test_near_recall_where_all_levels_are_heavy(docs):
    """Pairs exactly at the threshold, in nodes that stay heavy at each level."""
    rows, n = [], 3000
    for i in range(n):
        common = [f"c{i}x{k}" for k in range(64)]
        for side in (0, 1):
            rows.append((2 * i + side, " ".join(common + [f"t{i}x{side}x{k}" for k in range(10)])))
    a, b = (shingle_set(rows[k][1]) for k in (0, 1))
    assert 100 * len(a & b) == 75 * len(a | b)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs(rows), node_weight=64).collect()}
    assert all(got[x] in (x, x - x % 2) for x in got)
    missed = sum(got[2 * i + 1] != 2 * i for i in range(n))
    assert missed <= 0.001 * n, missed


def test_near_confirms_words_that_simple_hashes_confuse(docs):
    """Words over two letters in the Thue-Morse order and its complement cancel out
    in any polynomial hash modulo 2^64."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
    other = word.translate({97: 98, 98: 97})
    rows = [(1, "one two three four five " + word), (2, "one two three four five " + other)]
    long = ["x y " * 200_000, "é" * 300_000 + " b c", " ".join(f"w{i % 777}" for i in range(150_000))]
    for k, text in enumerate(long):  # texts that are read in pieces
        rows += [(10 * k + 11, text), (10 * k + 12, text.upper().replace("É", "é") + "\n"), (10 * k + 13, "else " + text + " more")]
    check_near(docs, rows)


def test_shingle_sets_are_exact():
    texts = ["a b c d e f a b c d e", None, "", "A", "a", "a a", "a b", "é \t x", "b c d e f a b"]
    got = near_dup.shingle_sets(pa.array(texts))
    for x, s in zip(texts, got, strict=True):
        for y, t in zip(texts, got, strict=True):
            assert near_dup.overlap(s, t) == len(shingle_set(x) & shingle_set(y)) and len(s) == len(shingle_set(x))


def test_different_documents_of_one_id_stay(docs):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "quite other words of the same id"), (7, "A b c d e f"), (8, None), (8, None), (None, "a b c d e f"), (None, "a b c d e f")]
    left = near_dup.drop_near_duplicates(docs(rows, extra=True)).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left) == [("5", "a b c d e f"), ("5", "quite other words of the same id"), ("8", "None"), ("8", "None"), ("None", "a b c d e f"), ("None", "a b c d e f")]
    assert near_dup.drop_near_duplicates(docs([])).count() == 0


def test_near_edges(docs):
    assert near_dup.near_duplicates(docs([])).count() == 0
    got = near_dup.near_duplicates(docs([(None, "a b c d e f"), (5, "a b c d e f"), (5, "other words of the same id here"), (7, "a b c d e f")])).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == [("5", "5", True), ("5", "5", True), ("7", "5", False), ("None", "None", True)]
    left = near_dup.drop_near_duplicates(docs([(5, "a b c d e f"), (5, "a b c d e f"), (7, "a b c d e f"), (8, None), (9, None)])).collect()
    assert sorted(r["doc_id"] for r in left) == [5, 8, 9]
