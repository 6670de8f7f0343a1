"""Alignment, ranked search and decontamination against brute force on small tables with the odd cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from floodgauge.llm import alignment, decontaminate, lexical

SCHEMA = "doc_id long, text string, length int, row long, hash long, item string, n long, block string, place int, score long, kept boolean"
EXTRA = (1, 2, 3, "i", 4, "b", 5, 6, True)
ITEM = "item_id long, text string, words int, round int, term string"
ODD = [None, "", " \n\t", "a", "A", "word", "two words", "x\n\ny  z ", "é ü ß 日本語 🙂", "a" * 3000, "don't  stop, <|endoftext|> now.", " lead", "trail ", "\n", "İ, i", "word ▁ x", "ÉÉ é", "ha " * 300]


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(None if t == "no id" else start + i, t, *EXTRA) for i, t in enumerate(texts)], SCHEMA)


def items_of(spark, texts):
    return spark.createDataFrame([(i, t, 1, 2, "t") for i, t in enumerate(texts)], ITEM)


def sentences(seed, n, words, low, high):
    rng = random.Random(seed)
    return [" ".join(rng.choice(words) for _ in range(rng.randint(low, high))) for _ in range(n)]


# ---- decontamination ---------------------------------------------------------------------------------


def brute_contamination(docs, items, span=10):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    windows = defaultdict(set)
    for i, t in items:
        w = cut(t)
        for p in range(len(w) - min(span, len(w)) + 1 if w else 0):
            windows[tuple(w[p : p + min(span, len(w))])].add(i)
    out = []
    for i, t in docs:
        w, hit, ids = cut(t), set(), set()
        for n in {len(x) for x in windows}:
            for p in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[p : p + n]))) is not None:
                    hit.update(range(p, p + n))
                    ids |= own
        names = sorted(str(x) for x in ids if x is not None)
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check_contamination(spark, docs, items, **options):
    d, b = docs_of(spark, docs), items_of(spark, items).union(spark.createDataFrame([(None, "nobody names these ten words of an item without id", 1, 2, "t"), (0, items[0], 1, 2, "t")], ITEM))
    d = d.union(d.where("doc_id = 3"))
    want = brute_contamination([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()], options.get("span", 10))
    got = decontaminate.contamination(d, b, **options)
    assert sorted(map(tuple, got.collect()), key=str) == want
    return got


def test_decontaminate(spark):
    vocabulary = ["alpha", "beta", "Gamma", "delta", "é", "zeta", "eta"]
    items = sentences(1, 12, vocabulary, 10, 40) + ["one two three four five six seven", "lone", "", None, "ha " * 30, "ÉÉ é a b c d e f g h i"]
    rng = random.Random(2)
    docs = [*ODD, "no id", "nobody names these ten words of an item without id", *sentences(3, 40, vocabulary, 0, 80), "so: one two three four five six seven. Lone", "éé é a b c d e f g h i j", "ÉÉ é A,B;C d e f g h i j"]
    for t in items[:12]:
        w = t.split()
        p = rng.randint(0, len(w) - 10)
        docs += ["before " + ", ".join(w[p : p + 10]).upper() + " after", " ".join(w[p : p + 9]) + " no"]
    got = check_contamination(spark, docs, items)
    check_contamination(spark, docs, items[:12], span=6, gram=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_decontaminate_nothing(spark):
    docs, items = docs_of(spark, ODD), items_of(spark, ["a word of an item"])
    none = decontaminate.contamination(docs, items.limit(0))
    assert none.count() == len(ODD) and none.where("contaminated OR n_items > 0").count() == 0
    assert decontaminate.contamination(docs, items_of(spark, [None, "", " ,"])).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.limit(0), items).count() == 0


def test_winnowing_keeps_a_hash_of_every_span(spark):
    """Shared spans of every offset against a long text have a kept hash at the same place."""
    words = sentences(5, 1, [f"w{i}" for i in range(40)], 400, 400)[0].split()
    frame = lambda rows: spark.createDataFrame([(" ".join(r),) for r in rows], "text string").select("text", decontaminate.word_hashes(F.col("text")).alias("hashes"))
    kept = lambda df: {(r.hash, r.place) for r in decontaminate.kept_hashes(df, 10, 5, False).collect()}
    long = kept(frame([words]))
    assert len(long) < 0.5 * len(words)
    for p in range(0, 390, 7):
        part = kept(frame([["x", *words[p : p + 10], "y"]]))
        assert any((h, place - 1 + p) in long for h, place in part)


# ---- ranked search -----------------------------------------------------------------------------------


def brute_search(docs, items, k):
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "") if w]
    low = lambda ws: [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in ws]
    held = [(i, Counter(low(cut(t)))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n_docs, total = len(held), sum(n for *_, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for at, (i, c, n) in enumerate(held):
            m, s = 75 + (25 * n * n_docs) // total, 0
            for t in low(cut(text)):
                if c[t]:
                    s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, at))
        out += [(item, r, None if none else i, -s) for r, (s, none, i, _) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("first, growth", [(1, 2), (10, 4), (2000, 4)])
def test_lexical_search(spark, first, growth):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(200)]
    common = [rng.choices(words, [1 / (i + 1) for i in range(200)], k=rng.randint(1, 60)) for _ in range(300)]
    texts = [*ODD, "no id", "no id", *[" ".join(w).title() if i % 3 else ", ".join(w) for i, w in enumerate(common)], *["same words here w5"] * 30]
    docs = docs_of(spark, texts)
    docs = docs.union(docs.where("doc_id = 30"))
    items = items_of(spark, [" ".join(rng.sample(words, 12)) for _ in range(8)] + ["same words", "w0 w0 w0 W1", "unheard-of", "", None, "é ß ha"])
    items = items.union(items.where("item_id = 0"))
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 7)
    assert sorted(map(tuple, lexical.search(docs, items, 7, first, growth).collect()), key=str) == want


def test_lexical_search_closes_items_early(spark):
    """Frequent terms make no accumulators once the rare ones have decided."""
    texts = [f"the of and rare{i % 40} rarer{i % 40}" for i in range(4000)]
    docs, items = docs_of(spark, texts), items_of(spark, ["the of and rare7 rarer7"])
    seen = []
    keep = lexical.materialize

    def counting(df, name):
        out = keep(df, name)
        if name == "accumulators":
            seen.append(out.count())
        return out

    lexical.materialize = counting
    try:
        assert lexical.search(docs, items, 20, 50).count() == 20
    finally:
        lexical.materialize = keep
    assert sum(seen) <= 200


def test_lexical_search_of_nothing(spark):
    docs, items = docs_of(spark, ODD), items_of(spark, ["a word"])
    assert lexical.search(docs.limit(0), items).count() == 0 and lexical.search(docs, items.limit(0)).count() == 0
    assert lexical.search(docs, items_of(spark, [None, "?!"])).count() == 0


# ---- alignment ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_tokens(texts, paths):
    """Per text: ids and byte bounds of both sides, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1])
    a.encode_special_tokens = True
    table = alignment.ByteLevel(paths[0]).entries
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:-1], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    out = []
    for t in texts:
        ia, ib = a.encode(" " + (t or ""), add_special_tokens=False).ids, b.encode(t or "")
        ea, eb, want = [table[i] for i in ia], [piece(i) for i in ib], (" " + (t or "")).encode()
        good = t and b"".join(ea) == want and b"".join(eb) == want
        out.append((ia, ib, np.cumsum([0, *map(len, ea)]), np.cumsum([0, *map(len, eb)])) if good else None)
    return out


def brute_alignment(tokens):
    if tokens is None:
        return [], "", 0
    ia, ib, ca, cb = tokens
    links = [(p, q) for p in range(len(ia)) for q in range(len(ib)) if max(ca[p], cb[q]) < min(ca[p + 1], cb[q + 1])]
    groups, p, q = [], 0, 0
    for c in sorted(set(ca[1:]) & set(cb[1:])):
        end_a, end_b = int(np.searchsorted(ca, c)), int(np.searchsorted(cb, c))
        groups.append(",".join(map(str, ia[p:end_a])) + "|" + ",".join(map(str, ib[q:end_b])))
        p, q = end_a, end_b
    return links, ";".join(groups), len(groups)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    signs = [*" \n\t .,'aeZ1é !?_-", "the", "ing", "'s", "<|endoftext|>", "<s>", "日本", "🙂", "İ", "　", "́", "ﬁ", " word", "don't", ") ", "..."]
    return ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_aligned_blocks_of_text(paths):
    texts = [*ODD, *random_texts(1500)]
    for _ in range(2):  # from an empty cache, and from a filled one
        x = alignment.Aligned(pa.array(texts), *paths)
        left, right, at = x.links()
        raw, cuts = x.groups_text()
        for i, tokens in enumerate(brute_tokens(texts, paths)):
            links, text, n = brute_alignment(tokens)
            assert sorted(zip((left[at[i] : at[i + 1]] - x.a[1][i]).tolist(), (right[at[i] : at[i + 1]] - x.b[1][i]).tolist())) == links
            assert raw[cuts[i] : cuts[i + 1]].decode() == (text and text + ";") and x.per_text(x.fresh_a, x.a[1])[i] == n


def test_alignment_counts(spark, paths, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK_TEXT", 500)
    docs = docs_of(spark, [*ODD, "no id", *random_texts(120, 9)])
    docs = docs.union(docs.where("doc_id = 6"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    each, counts = [], Counter()
    for tokens in brute_tokens([t for _, t in rows], paths):
        links, text, n = brute_alignment(tokens)
        pairs = [(tokens[0][p], tokens[1][q]) for p, q in links]
        counts.update(pairs)
        each.append((tokens, pairs, text, n))
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = []
    for (i, _), (tokens, pairs, text, n) in zip(rows, each):
        sizes = (len(tokens[0]), len(tokens[1])) if tokens else (0, 0)
        want.append((i, *sizes, n, len(pairs), sum(counts[p] == best[p[1]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    got = alignment.alignment_counts(docs.repartition(3), *paths)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert alignment.alignment_counts(docs.limit(0), *paths).count() == 0


def test_aligned_tokens(spark, paths):
    docs = docs_of(spark, [*ODD, *random_texts(30, 4)])
    got = {r.doc_id: r for r in alignment.aligned_tokens(docs, *paths).collect()}
    for i, tokens in enumerate(brute_tokens([r.text for r in docs.orderBy("doc_id").collect()], paths)):
        links, text, n = brute_alignment(tokens)
        r = got[i]
        assert (r.a_ids, r.b_ids) == ((list(tokens[0]), list(tokens[1])) if tokens else ([], []))
        assert sorted(zip(r.link_a, r.link_b)) == links and len(set(r.a_groups)) == n and set(r.a_groups) == set(range(n)) == set(r.b_groups)
    assert alignment.aligned_tokens(docs.limit(0), *paths).count() == 0
