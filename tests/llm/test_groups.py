"""SimHash groups, spelling variants and source divergence against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_helpers import EDGES, documents  # noqa: F401
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tallymark.llm import divergence, simhash, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- SimHash ------------------------------------------------------------------

def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or (
        [" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def reach(prints, linked):
    """The smallest id each print reaches, from {print: ids}."""
    left, out = set(prints), {}
    while left:
        group, waiting = set(), [left.pop()]
        while waiting:
            one = waiting.pop()
            group.add(one)
            near = {p for p in left if linked(one, p)}
            left -= near
            waiting += near
        ids = [i for p in group for i in prints[p] if i is not None]
        out |= dict.fromkeys(group, min(ids, default=None))
    return out


def slow_groups(rows):
    prints = defaultdict(list)
    for d, t in rows:
        prints[slow_print(t)].append(d)
    found = reach(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    return sorted(((d, f"{slow_print(t):016x}", found[slow_print(t)]) for d, t in rows), key=repr)


@pytest.mark.parametrize("block", [8192, 6])
def test_simhash_groups(documents, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PAIRS_HELD", 50)
    rng = random.Random(1)
    rows = list(EDGES) + [(8, "A b"), (9, "a  B\n"), (10, "naïve É é"), (None, "a b")]
    for i in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([3, 40, 300]))]
        for j in range(6):  # near copies, of which long ones link
            own = list(base)
            for _ in range(j):
                own[rng.randrange(len(own))] = f"x{rng.randrange(99)}"
            rows.append((100 + 10 * i + j, rng.choice([" ", "\n"]).join(own)))
    df = documents(rows)
    got = simhash.near_fingerprints(df)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == slow_groups(rows)
    assert simhash.near_fingerprints(documents([])).count() == 0


@pytest.mark.parametrize("block", [10_000, 40])
def test_trie_finds_all_links(spark, monkeypatch, block):
    """Crowded sub-tries, among them prints of one quarter, and the ends of the range."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "LEAVES_HELD", 64)
    rng = random.Random(2)
    prints = {0, 2 ** 64 - 1, 1 << 63, 7, 15}
    for base, spread in ((rng.getrandbits(64), 64), (rng.getrandbits(64), 20), (0xFFFF << 48, 30)):
        prints |= {base ^ sum(1 << rng.randrange(spread) for _ in range(rng.randrange(6)))
                   for _ in range(300)}
    prints = {p & (2 ** 64 - 1) for p in prints}
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    edges = simhash.trie_edges(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    pairs = {(u % 2 ** 64, v % 2 ** 64) for u, v in edges}
    assert all((u ^ v).bit_count() <= 64 and u in prints and v in prints for u, v in pairs)
    near = defaultdict(set)
    for u, v in pairs:
        near[u].add(v)
        near[v].add(u)
    ids = {p: [i] for i, p in enumerate(sorted(prints))}
    assert reach(ids, lambda a, b: b in near[a]) == reach(
        ids, lambda a, b: (a ^ b).bit_count() <= 3)


# -- spelling -------------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def slow_words(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def slow_variants(rows):
    words, out, forms = slow_words(rows), [], {}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 2 * n:
            forms[w] = best
    for w, n in words.items():
        root = w
        while root in forms:
            root = forms[root]
        out.append((w, forms.get(w), root, n, len(near[w]), words.get(forms.get(w))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [2048, 3])
def test_spelling_variants(documents, monkeypatch, block):
    for name, value in (("BLOCK", block), ("WORDS_HELD", 50), ("TILE_BYTES", 400), ("COUNTED", 40)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(3)
    pool = ["river", "rivers", "rivets", "drive", "aaaaa", "aaaaaa", "aaaab", "baaaa", "straße",
            "strasse", "Größe", "größe", "grösse", "naïve", "naive", "naives", "×÷×÷×", "abcdefgh",
            "abcdefg", "bcdefgh", "zabcdefgh"]
    for _ in range(60):
        word = list(rng.choice(pool))
        word[rng.randrange(len(word))] = rng.choice(["", "a", "b", "ÿ", "xy"])
        pool.append("".join(word))
    rows = [(d, " ".join(rng.choice(pool[:rng.randrange(1, len(pool))]) for _ in range(40)))
            for d in range(150)] + EDGES + [(3, "rivers, rivers"), (3, "rivers, rivers")]
    got = spelling.spelling_variants(documents(rows))
    assert sorted(map(tuple, got.collect()), key=repr) == slow_variants(rows)
    assert any(r[1] for r in slow_variants(rows)) and any(r[2] != (r[1] or r[0]) for r in slow_variants(rows))
    assert spelling.spelling_variants(documents([])).count() == 0


def test_long_words_stay_in_bounds(documents, monkeypatch):
    monkeypatch.setattr(spelling, "TILE_BYTES", 1 << 16)
    rows = [(d, " ".join(["x" * 50_000, "x" * 50_001, "y" + "x" * 50_000])) for d in range(4)]
    got = spelling.spelling_variants(documents(rows)).select("n", "n_near").collect()
    assert sorted(map(tuple, got)) == [
        (n, c) for w, _, _, n, c, _ in sorted(slow_variants(rows), key=lambda r: (r[3], r[4]))]


# -- divergence -----------------------------------------------------------------

def slow_divergence(rows):
    groups, langs, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = [t.translate(LOWER) for t in
                 re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang, source].update(terms)
        langs[lang].update(terms)
        seen[lang].update(set(terms))
    out = []
    for (lang, source), counts in groups.items():
        kept = [t for t in langs[lang] if seen[lang][t] >= 3]

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 1) // (total + len(kept)) for t in kept}

        p, q = shares(counts), shares(langs[lang])
        parts = {"pair": [(other, sum((p[t] - r[t]) ** 2 // r[t] for t in kept))
                          for (la, other), c in groups.items() if la == lang and other != source
                          for r in [shares(c)]],
                 "term": [(t, (p[t] - q[t]) ** 2 // q[t]) for t in kept
                          if counts[t] and p[t] > q[t]]}
        for part, items in parts.items():
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, value, k) for k, (item, value) in enumerate(
                items[:200] if part == "term" else items, 1)]
    return sorted(out)


def test_source_divergence(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SHARD_TERMS", 60)
    monkeypatch.setattr(divergence, "COUNTED", 100)
    monkeypatch.setattr(divergence, "PAIRS_HELD", 3)
    rng = random.Random(5)
    pool = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)] + ["Über", "ÜBER", "日本", "a-b"]
    rows = [(rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "ä", "Z", None]),
             rng.choice([" ", "1", "\x00", "`"]).join(
                 rng.choice(pool) for _ in range(int(rng.paretovariate(0.6)) % 500)))
            for _ in range(150)]
    rows += [("fr", "s1", None), ("fr", "s2", "only once"), ("en", "empty", ""), ("xx", "s", "a b")]
    rows += [("en", "s1", "twice twice")] * 2
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "lang string, source string, text string, n int, item string")
    got = divergence.source_divergence(df.repartition(3))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == slow_divergence(rows)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 0, 1), (5, 10, 3), (10 ** 13, 10 ** 15 + 7, 10 ** 9), (10 ** 18, 10 ** 18, 1)]
    got = spark.createDataFrame(cases, "n long, total long, v long").select(
        divergence.share(F.col("n"), F.col("total"), F.col("v"))).collect()
    assert [r[0] for r in got] == [1 + 10 ** 9 * (n + 1) // (total + v) for n, total, v in cases]
    column = divergence.RunColumn(np.array([1]), np.array([10 ** 13]), 3, 10 ** 15 + 7, 10 ** 9)
    assert column.share.tolist() == [1, 1 + 10 ** 9 * (10 ** 13 + 1) // (10 ** 15 + 7 + 10 ** 9), 1]
