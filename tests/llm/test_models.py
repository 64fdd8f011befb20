"""Language ID, quality, toxicity, mixing, URL rules, embeddings and BPE."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstone.llm import bpe, embedding_dup, language_id, mixing, quality, toxicity, url_filter
from quillstone.llm.common import Texts

WORDS = {"en": ["the", "thing", "and", "here", "of"], "de": ["der", "und", "schön", "einlich", "zu"], "fr": ["être", "la", "que", "eaux", "ment"]}


def prose(rng, lang, n=40):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


@pytest.fixture
def corpus(docs):
    rng = random.Random(1)
    return docs([(i, prose(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choice(list(WORDS)) for _ in range(150))], extra=True)


# ------------------------------------------------------------------ language id
def ppm_bits(train, text):
    """Code length by definition: contexts of up to ORDER bytes, method C, with
    exclusion, a text preceded by three unknown bytes."""
    pad = [None] * language_id.ORDER
    counts = defaultdict(Counter)
    for t in train:
        s = pad + list(t.lower())
        for i in range(language_id.ORDER, len(s)):
            for o in range(language_id.ORDER + 1):
                counts[tuple(s[i - o : i])][s[i]] += 1
    s, total = pad + list(text.lower()), 0.0
    for i in range(language_id.ORDER, len(s)):
        excluded = set()
        for o in range(language_id.ORDER, -1, -1):
            seen = {b: n for b, n in counts[tuple(s[i - o : i])].items() if b not in excluded}
            n = sum(seen.values())
            if not n:
                continue
            if s[i] in seen:
                total -= math.log2(seen[s[i]] / (n + len(seen)))
                break
            total -= math.log2(len(seen) / (n + len(seen)))
            excluded |= set(seen)
        else:
            total += math.log2(256 - len(excluded))
    return total


def test_ppm_matches_the_definition():
    samples = [("de", "Der und schön".encode()), ("de", b"und zu"), ("en", b"the thing"), ("en", b"here the")]
    model = language_id.fit(samples)
    texts = ["the end", "schön!", "", "zzz\u4e00", "und der the"]
    bits = language_id.code_lengths(model, Texts(pa.array(texts)))
    for i, t in enumerate(texts):
        for j, lang in enumerate(model.languages):
            assert bits[i, j] == pytest.approx(ppm_bits([x for k, x in samples if k == lang], t.encode()), rel=1e-5, abs=1e-5)


def test_languages_held_out(corpus, docs):
    found = {r["doc_id"]: r for r in language_id.identify_languages(corpus).collect()}
    truth = {r["doc_id"]: r["lang"] for r in corpus.collect()}
    own = [i for i, r in found.items() if r["held_out"]]
    assert own and all(found[i]["lang_pred"] == truth[i] for i in own)
    odd = docs([(1, None), (2, "123 !"), (3, ""), (None, "the thing and", None)])
    assert [r["lang_pred"] for r in language_id.identify_languages(odd.union(corpus.select(odd.columns))).limit(4).collect()] == ["und", "und", "und", "en"]
    assert {r["lang_pred"] for r in language_id.identify_languages(docs([(1, "the", None)])).collect()} == {"und"}
    assert language_id.identify_languages(docs([])).count() == 0


# ---------------------------------------------------------------------- quality
def kneser_ney(counts):
    """Interpolated modified Kneser-Ney over word pairs by definition: p(v, w)."""
    more = Counter(w for _, w in counts)

    def cuts(table):
        n = Counter(table.values())
        if not n[1] or not n[2]:
            return lambda c: 0.5
        y = n[1] / (n[1] + 2 * n[2])
        d = [1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3] if n[3] else 1.5]
        d = [min(max(v, 0.05), i + 0.95) for i, v in enumerate(d)]
        return lambda c: d[min(c, 3) - 1]

    long, short = cuts(counts), cuts(more)

    def below(w):
        total = sum(more.values())
        own = more[w] - short(more[w]) if w in more else 0
        return own / total + sum(short(c) for c in more.values()) / total / (len(more) + 1)

    def p(v, w):
        follow = {x: n for (u, x), n in counts.items() if u == v}
        if not follow:
            return below(w)
        total = sum(follow.values())
        own = follow[w] - long(follow[w]) if w in follow else 0
        return own / total + sum(long(c) for c in follow.values()) / total * below(w)

    return p


@pytest.mark.parametrize("contexts, broadcast_terms", [(256, 10**6), (2, 3), (0, 0)])
def test_perplexity_matches_the_definition(docs, spark, monkeypatch, contexts, broadcast_terms):
    monkeypatch.setattr(quality, "GATHER", 7)
    rng = random.Random(8)
    trusted = ["the thing and the", "and Here\tthe thing", "there the"] + [prose(rng, "en", rng.randint(1, 30)) for _ in range(20)]
    other = ["the and", "zzz qqq", "the the the the", "", " \n", None, "zzz " * 70000 + "the thing" + " " * 300000 + "and\u00a0here here"]
    rows = list(enumerate(trusted + other))
    labels = spark.createDataFrame([(i, int(i < len(trusted)), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    split = lambda t: ["<"] + [w.lower() for w in re.split("[\x20\x09-\x0d]+", t) if w] + [">"]
    pairs = lambda t: [(v if v in own else "*", w) for v, w in zip(split(t), split(t)[1:])]
    pairs = lambda t: [(v if v in own else "*", w) for v, w in zip(split(t), split(t)[1:])]
    from pyspark.sql import functions as F

    apart = {r[0] for r in spark.range(len(trusted)).where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(quality.HELD_OUT)) == 0).collect()}
    counted = [t for i, t in [*enumerate(trusted), (0, trusted[0]), (0, trusted[0])] if i not in apart]
    often = Counter(w for t in counted for w in split(t)[1:-1]).most_common()
    assert len(often) > 2 and often[1][1] > often[2][1]
    own = {"<", *(w for w, _ in often[:contexts])}
    counts = Counter(g for t in counted for g in pairs(t))
    found = quality.classify_quality(docs([*rows, rows[0], rows[0], (None, "the thing", None)], extra=True), labels, contexts=contexts, broadcast_terms=broadcast_terms).collect()
    assert sorted(r["doc_id"] for r in found if r["doc_id"] is not None) == [0, 0, *range(len(rows))] and {r["n_words"] for r in found if r["doc_id"] == 0} == {4}
    got, p = {r["doc_id"]: r for r in found}, kneser_ney(counts)
    for i, t in [*rows, (None, "the thing")]:
        terms = split(t or "")
        assert got[i]["n_words"] == len(terms) - 2
        if len(terms) == 2:
            assert got[i]["perplexity"] is None
            continue
        each = Counter(pairs(t))
        want = math.exp(-sum(n * math.log(p(*g)) for g, n in each.items()) / (len(terms) - 1))
        assert got[i]["perplexity"] == pytest.approx(want, rel=1e-6)


def test_every_word_is_a_context(docs, spark, monkeypatch):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(600)]
    rng.shuffle(words)
    trusted = [" ".join(words[i : i + 40]) for i in range(0, 600, 20)] * 2
    other = [" ".join(words[100:130]), " ".join(sorted(words[100:130]))]  # known pairs, and the same words in another order
    rows = list(enumerate(trusted + other))
    labels = spark.createDataFrame([(i, int(i < len(trusted)), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    apart = {r[0] for r in spark.range(len(trusted)).where(F.pmod(F.xxhash64("id", F.lit(31)), F.lit(quality.HELD_OUT)) == 0).collect()}
    split = lambda t: ["<", *t.split(), ">"]
    counts = Counter(g for i, t in enumerate(trusted) if i not in apart for g in zip(split(t), split(t)[1:]))
    assert len({v for v, _ in counts}) > 500
    p = kneser_ney(counts)
    for common, broadcast_terms, bucket_bytes in ((65000, 10**6, 1 << 24), (200, 50, 1000), (0, 0, 1000)):  # where pairs meet makes no difference
        monkeypatch.setattr(quality, "COMMON", common)
        monkeypatch.setattr(quality, "BUCKET_BYTES", bucket_bytes)
        got = {r["doc_id"]: r for r in quality.classify_quality(docs(rows), labels, broadcast_terms=broadcast_terms).collect()}
        for i, t in rows:
            pairs = list(zip(split(t), split(t)[1:]))
            assert got[i]["perplexity"] == pytest.approx(math.exp(-sum(math.log(p(*g)) for g in pairs) / len(pairs)), rel=1e-6)


def test_quality_limits(docs, spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, "en"), "en") for i in range(420)] + [(1200 + i, "".join(rng.choice("qxzj#!9 ") for _ in range(90)), "en") for i in range(10)] + [(1300, None, None)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in quality.classify_quality(docs(rows), labels).collect()}
    assert sum(got[i] for i in range(420)) > 400 and not any(got[1200 + i] for i in range(10)) and not got[1300]
    assert quality.classify_quality(docs([]), labels).count() == 0
    assert all(r["kept"] for r in quality.classify_quality(docs([(1, "x y")]), labels.limit(0)).collect())


# --------------------------------------------------------------------- toxicity
def test_toxicity_held_out(docs, spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = prose(rng, "en", 30).split()
        if toxic:
            words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(docs(rows + [(1000, None), (1001, "")], extra=True), table).collect()
    own = [r for r in got if r["held_out"] and r["doc_id"] < 400]
    assert own and all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in own)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 402
    left = {r["doc_id"] for r in toxicity.reject_toxic(docs(rows), table).collect()}
    assert left == {i for i in range(400) if i % 5}
    assert [r["score"] for r in toxicity.score_toxicity(docs([(1, "x")]), table.limit(0)).collect()] == [0.0]
    assert toxicity.score_toxicity(docs([]), table).count() == 0


def test_whole_text_is_read(docs, spark):
    model = toxicity.fit([("fine words here", 0), ("utter scum here", 1)] * 30)
    far = "fine " * 30_000 + "scum"
    text = " ".join([far] * 3)
    low, high = toxicity.score_column(model, pa.array(["fine " * 300_000, text]))
    assert high > low and len(text) > 1 << 18
    at_once = toxicity.responses(model, Texts(pa.array([text]))) @ model.out + model.base
    assert high == pytest.approx(1 / (1 + math.exp(-at_once[0])), rel=1e-5)


def test_forward_pass_by_plain_loops():
    """The vectorised responses against loops over words, filters and widths."""
    model = toxicity.fit([("fine words here now", 0), ("utter scum here", 1)] * 8)
    texts = ["fine scum", "", "here utter words now scum fine", "now"]
    got = toxicity.responses(model, Texts(pa.array(texts)))
    block = {w: sum(toxicity.WIDTHS[:k]) for k, w in enumerate(toxicity.WIDTHS)}
    for t, row in zip(texts, got, strict=True):
        one, two, words = toxicity._indices(Texts(pa.array([t])))
        for k, w in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best = 0.0
                for i in range(words.n - w + 1):
                    cell = [(block[w] + j) * toxicity.FILTERS + f for j in range(w)]
                    best = max(best, model.bias[k * toxicity.FILTERS + f] + sum(model.tables[0][one[i + j], c] + model.tables[1][two[i + j] - toxicity.BUCKETS, c] for j, c in enumerate(cell)))
                assert row[k * toxicity.FILTERS + f] == pytest.approx(best, abs=1e-4)


# ----------------------------------------------------------------------- mixing
def test_rates_meet_targets(corpus):
    weights = {"en": 0.6, "de": 0.3, "fr": 0.1}
    rows = mixing.document_rates(corpus, weights=weights).collect()
    names, targets = rows[0]["domains"], np.array(rows[0]["targets"])
    total = sum(r["n_tokens"] for r in rows)
    assert targets == pytest.approx([weights[d] * total for d in names])
    met = sum(r["rate"] * r["n_tokens"] * np.array(r["posterior"]) for r in rows)
    assert met == pytest.approx(targets, rel=1e-3) and all(r["rate"] >= 0 for r in rows)


def test_mixing_repeats_and_edges(corpus, docs):
    out = mixing.mixed(corpus)
    assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in corpus.select("doc_id").collect()} and out.columns == corpus.columns
    assert mixing.document_rates(docs([])).count() == 0
    assert [r["rate"] for r in mixing.document_rates(docs([(1, "a b", None), (2, None, None)])).collect()] == [1.0, 1.0]
    got = mixing.document_rates(docs([(1, None, "en"), (None, "the thing", "en"), (3, "la que", "fr")])).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 2, 2]


# ------------------------------------------------------------------------- urls
def judged(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, tail = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
    fits = [(len(h + p), h + p) for _, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None


URLS = [
    "http://a.example.com/en/7", "http://EXAMPLE.com/en/8?x=/en/7", "https://example.net/de/81#t", "https://x.net/de/", "ftp://y.org/es/", "http://notcom/en/", "http://com/en/1",
    None, "no scheme", "http://", "http://h?q=1", "x://y://z/a", "http://é.com/en/7", "http://a.com:80/en/", "http://xexample.com/en/7",
]


def test_urls_match_brute_force(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    verdicts = {h + p: v for v, h, p in url_filter.RULES}
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got == {i: (*judged(u), verdicts.get(judged(u)[2], "allow")) for i, u in enumerate(URLS)}


def test_url_rules_have_the_words_of_the_contract(spark):
    """Words written out here, not taken from RULES; a mined rule that fits the urls doesn't overrule them."""
    want = {
        "http://x.com/en/1": ("com/en/", "block"), "http://example.com/en/8": ("com/en/", "block"), "http://a.example.com/en/71": ("example.com/en/7", "allow"),
        "http://x.net/de/8": ("net/de/", "allow"), "http://example.net/de/7": ("net/de/", "allow"), "http://xexample.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/8": ("example.net/de/8", "block"), "http://A.Example.NET/de/85/x?y": ("example.net/de/8", "block"),
        "http://x.org/es/": ("org/es/", "block"), "http://x.dev/de/8": (None, "allow"),
    }
    pages = spark.createDataFrame(list(enumerate(want)), "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got == dict(enumerate(want.values()))
    shown = [(100 + i, f"http://y.net/de/promo/{i}" if i < 30 else f"http://y.dev/{'promo' if i < 60 else 'plain'}/{i}") for i in range(90)]
    pages = spark.createDataFrame(shown, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(90)], "doc_id long, quality int, toxic int")
    got = {r["page_id"] - 100: (r["rule"], r["verdict"]) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got == {i: ("net/de/", "allow") if i < 30 else (None, "block" if i < 60 else "allow") for i in range(90)}


def test_mined_rules_block(spark):
    rng = random.Random(4)
    urls = [(i, f"http://{rng.choice(['a', 'b'])}.site.dev/{rng.choice(['news', 'shop'])}/{i}" + ("?promo=1" if i % 3 == 0 else "")) for i in range(300)]
    bad = {i: "/shop/" in u and "promo" in u for i, u in urls}
    labels = spark.createDataFrame([(i, 0 if bad[i] else 1, 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(pages, labels).collect()}
    assert got == {i: "block" if bad[i] else "allow" for i, _ in urls}
    tokens = {tuple(r["tokens"]) for r in url_filter.mine_rules(pages.join(labels, pages.page_id == labels.doc_id).selectExpr("url", "quality = 0 AS blocked")).collect()}
    assert ("p:shop", "q:promo") in tokens and not any(len(t) > 2 for t in tokens)


# ------------------------------------------------------------------- embeddings
def test_embeddings_match_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 64))
    rows = [(i, (base[i % 40] + rng.normal(size=64) * rng.choice([0, 0.1, 0.2])).tolist(), int(i % 3)) for i in range(400)]
    rows += [(600, [1e200] + [0.0] * 63, 2), (601, [0.0, 1e200] + [0.0] * 62, 2), (602, [1e-200] + [0.0] * 63, 2), (603, [1e-310] + [0.0] * 63, 2), (604, [1e308] * 64, 2), (605, [1e-300] * 64, 2)]
    rows += [(400 + i, rows[0][1], rows[0][2]) for i in range(5)] + [(500, None, 1), (501, [0.0] * 64, 1), (502, [float("nan")] * 64, 1), (503, rows[0][1], None), (504, [1.0, 2.0], 1), (505, [], 1), (506, [2 * v for v in rows[0][1]], rows[0][2])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    unit = lambda v: v / np.linalg.norm(v)
    fine = {i: (unit(np.array(v) / np.abs(v).max()), k) for i, v, k in rows if v and k is not None and np.isfinite(v).all() and np.any(v)}
    links = defaultdict(set)
    for i, (v, k) in fine.items():
        for j, (u, m) in fine.items():
            if i != j and k == m and len(u) == len(v) and float(u @ v) >= 0.98:
                links[i].add(j)
    want = {}
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        want[i] = (len(links[i]), min(seen), i == min(seen))
    for options in ({}, {"cuts": 2, "block": 16}):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dup.embedding_duplicates(frame, **options).collect()}
        assert got == want
    assert embedding_dup.embedding_duplicates(frame.limit(0)).count() == 0


# -------------------------------------------------------------------------- bpe
@pytest.fixture(scope="module")
def tokenizers():
    public = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers")
    path = str(public.path("byte_bpe_50k.json"))
    return bpe.load(path), library.Tokenizer.from_file(path), path


def test_bpe_classes_of_later_letters(tokenizers):
    tok, library, _ = tokenizers
    for a, b in bpe.LATER:
        for c in {a, b, a - 1, b + 1}:
            for form in ("a%s1", "1%sa", "!%s!", " %s"):
                text = form % chr(c)
                assert ids_of(tok, text) == library.encode(text, add_special_tokens=False).ids, hex(c)


def ids_of(tok, text):
    return np.frombuffer(tok.encode(text), "<u4").tolist()


@settings(max_examples=400, deadline=None)
@given(text=st.text(st.characters(exclude_categories=["Cs"]), max_size=60) | st.text("ab eth'ls\n\t 01!é", max_size=80))
def test_bpe_equals_the_library(tokenizers, text):
    tok, library, _ = tokenizers
    ids = library.encode(text, add_special_tokens=False).ids
    assert ids_of(tok, text) == ids
    assert tok.decode(tok.encode(text)) == library.decode(ids, skip_special_tokens=False) == text


def test_bpe_special_long_and_edges(tokenizers, docs):
    tok, library, path = tokenizers
    for text in ["", "a<|endoftext|>b", "<|endoftext|>" * 3, "<|endoftext", "x" * 5000, "aaa" * 777 + " b", " \n \n  x", "w1 w2<|endoftext|> " * 100_000]:
        assert ids_of(tok, text) == library.encode(text, add_special_tokens=False).ids
    got = {r["doc_id"]: (r["n_tokens"], r["decoded"]) for r in bpe.encode(docs([(1, None), (2, ""), (None, "the thing"), (4, "q " * 50_000)], extra=True), path).collect()}
    assert got[1] == got[2] == (0, "") and got[None] == (2, "the thing") and got[4][1] == "q " * 50_000
    assert bpe.encode(docs([]), path).count() == 0


def test_automaton_agrees_with_merging(tokenizers):
    """Whether one token may follow another: the automaton against merging by rank."""
    tok, library, _ = tokenizers
    rng = random.Random(8)
    letters = [i for i, b in enumerate(tok.labels) if b.isalpha() and b.isascii() and b.islower()]
    for _ in range(3000):
        a, b = rng.choice(letters), rng.choice(letters)
        merged = library.encode((tok.labels[a] + tok.labels[b]).decode(), add_special_tokens=False).ids
        assert tok.follows(a, b) == (merged == [a, b])
