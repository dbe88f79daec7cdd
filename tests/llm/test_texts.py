from __future__ import annotations

import hashlib
import random
import re
import string
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from llm_helpers import EDGES, documents  # noqa: F401
from pyspark.sql import functions as F

from tallymark.llm import contamination, jaccard, lines, quality, toxicity, urls, warc

WHITE = " \t\n\v\f\r"


def words_of(rng, n, vocabulary=3000):
    return ["w" + string.ascii_lowercase[rng.randrange(26)] + str(rng.randrange(vocabulary))
            for _ in range(n)]


# -- line removal -------------------------------------------------------------

def slow_lines(rows):
    holders = defaultdict(set)
    key = lambda x: x.strip(WHITE).translate(
        str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    for d, t in rows:
        for x in (t or "").split("\n"):
            if d is not None and len(key(x)) >= 10:
                holders[key(x)].add(d)
    out = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if d is None or key(x) not in holders or min(holders[key(x)]) == d]
        out.append((d, len(own), len(own) - len(kept), None if t is None else "\n".join(kept)))
    return out


def test_lines(documents, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_LINES", 7)
    rng = random.Random(4)
    pool = [" ".join(words_of(rng, 3)) for _ in range(60)] + ["short", "ÄÖÜäöüßé", "ÄÖÜäöüßééé"]
    rows = [(d, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([x, x.upper()])
                          for x in rng.choices(pool, k=rng.randrange(12))))
            for d in range(40)] + EDGES + [(3, pool[0]), (3, pool[0]), (None, pool[1])]
    df = documents(rows)
    got = lines.dedup_lines(df)
    assert got.columns == df.columns + ["n_dropped"]  # the clashing n_lines is replaced
    assert sorted(map(repr, (tuple(r) for r in got.select(
        "doc_id", "n_lines", "n_dropped", "text").collect()))) == sorted(map(repr, slow_lines(rows)))
    assert lines.dedup_lines(documents([])).count() == 0
    assert lines.dedup_lines(df, counts=False).columns == df.columns


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 63, 5000):
        keys = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        function = lines.PerfectHash.build(keys)
        assert sorted(function.numbers(keys).tolist()) == list(range(len(keys)))
        other = function.numbers(keys ^ np.uint64(1 << 63))
        assert other.max(initial=-1) < max(1, len(keys))


def test_shard_with_equal_places():
    import pandas as pd
    rows = pd.DataFrame({"place": [5, 5, 9], "fingerprint": [1, 2, 3], "n_rows": [2, 2, 2],
                         "first": [10, 20, 30]})
    shard = lines.Shard(lines.shard_bytes(rows))
    found, first = shard.first_documents(np.array([[5, 2], [5, 1], [9, 3], [9, 4], [7, 1]], np.uint64))
    assert found.tolist() == [True, True, True, False, False]
    assert first[:3].tolist() == [20, 10, 30]
    once = lines.Shard(lines.shard_bytes(rows.assign(n_rows=[1, 2, 1000])))  # the counts are probed
    assert once.count.dtype == np.uint8
    assert once.first_documents(np.array([[5, 1], [5, 2], [9, 3]], np.uint64))[0].tolist() == [False, True, True]


# -- quality ------------------------------------------------------------------

def slow_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    marked = {}
    for n in quality.MAX_COVERAGE:
        grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
        count = Counter(grams)
        inside = set()
        for i, g in enumerate(grams):
            if count[g] > 1:
                inside.update(range(i, i + n))
        marked[n] = inside
    chars = sum(map(len, words))
    seen, dup, dup_chars = set(), 0, 0
    for x in (text or "").split("\n"):
        own = re.findall(r"[^\x20\x09-\x0D]+", x)
        if own and x in seen:
            dup, dup_chars = dup + 1, dup_chars + sum(map(len, own))
        if own:
            seen.add(x)
    failed = len(words) < 10 or 100 * len(marked[5]) > 20 * len(words)
    share = {n: sum(len(words[i]) for i in m) / chars if chars else 0 for n, m in marked.items()}
    kept = (not failed and all(share[n] <= m for n, m in quality.MAX_COVERAGE.items())
            and (dup_chars / chars if chars else 0) <= quality.MAX_LINE_COVERAGE)
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(marked[5]),
            failed, kept)


def test_quality(documents):
    rng = random.Random(8)
    rows = list(EDGES)
    for d in range(60):
        own = words_of(rng, rng.randrange(5, 80), rng.choice([3, 30, 3000]))
        own[1:1] = own[:rng.randrange(12)] if d % 3 else []
        rows.append((100 + d, "".join(w + rng.choice([" ", "\n", "\t ", "\xa0", "# "]) for w in own)))
    got = quality.rate(documents(rows)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept").collect()
    want = [(d, *slow_quality(t)) for d, t in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {r["kept"] for r in got} == {True, False}
    assert quality.rate(documents([])).count() == 0


def test_quality_tells_a_line_from_passages(documents):
    words = [f"w{i:04d}" for i in range(400)]
    cut = lambda w: [" ".join(w[i:i + 10]) for i in range(0, len(w), 10)]
    body = cut(words[:100])
    texts = {
        "one line twice": [*body, body[3]],
        "two lines twice": [*body, *cut(words[100:250]), body[3], body[7]],
        "one line three times": [*body, *cut(words[100:200]), body[3], body[3]],
        "passage on one line": [" ".join(words[:30]), " ".join(words[30:300]), " ".join(words[:30])],
        "passage in lines cut elsewhere": [*body, *cut(words[100:150]), "x " + " ".join(words[15:30])],
        "a line and a passage": [*body, *cut(words[100:260]), body[9],
                                 "x " + " ".join(words[20:36])],
        "little of much": [*cut(words), *body[:1], *body[5:6]],
    }
    rows = [(i, "\n".join(lines)) for i, lines in enumerate(texts.values())]
    found = {r["doc_id"]: r for r in quality.rate(documents(rows)).collect()}
    assert not any(r["base_failed"] for r in found.values())
    assert [name for i, name in enumerate(texts) if found[i]["kept"]] == [
        "one line twice", "little of much"]


# -- similarity join ----------------------------------------------------------

def shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i:i + 5]) for i in range(len(w) - 4)])


def slow_links(rows):
    sets = [shingles(t) for _, t in rows]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            same = not sets[i] and not sets[j] and (rows[i][1] or "") == (rows[j][1] or "")
            if same or both and 5 * both >= 4 * len(sets[i] | sets[j]):
                links[i], links[j] = links[i] + 1, links[j] + 1
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    smallest = {r: min((x for x in v if x is not None), default=None) for r, v in least.items()}
    return [(d, smallest[root(i)], links[i]) for i, (d, _) in enumerate(rows)]


def near_copies():
    rng = random.Random(6)
    rows = [r for r in EDGES if r[0] not in (5, 6)]
    shared = words_of(rng, 30)
    for _ in range(8):  # a passage that unrelated texts share
        rows.append((len(rows) + 50, " ".join(words_of(rng, 60) + shared + words_of(rng, 30))))
    for size in (2, 5, 40):
        base = words_of(rng, 100)
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(100)] = words_of(rng, 1)[0]
            rows.append((len(rows) + 50, " ".join(own)))
    rows += [(rows[-1][0] + 1, rows[-1][1]), (7, rows[-1][1].upper() + "!"), (None, rows[20][1])]
    return rows


@pytest.mark.parametrize("small", [False, True])
def test_similar_documents(documents, monkeypatch, small):
    if small:  # blocks of few members, compared pair by pair of blocks
        monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 4)
        monkeypatch.setattr(jaccard, "CLUSTER_BLOCK", 700)
    rows = near_copies()
    got = jaccard.similar_documents(documents(rows)).collect()
    assert sorted(map(repr, ((r["doc_id"], r["class_id"], r["n_links"]) for r in got))) == \
        sorted(map(repr, slow_links(rows)))


def test_keep_one(documents):
    rows = near_copies()
    df = documents(rows)
    kept = jaccard.keep_one(df)
    assert kept.columns == df.columns
    want = set()
    for (d, t), (_, c, _) in zip(rows, slow_links(rows)):
        if d == c and (d is not None or not shingles(t) or t == "no id here"):
            want.add((d, t))  # (1, None) stands for (2, "") as well
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in kept.collect()))) == \
        sorted(map(repr, want))
    assert jaccard.keep_one(documents([])).count() == 0


def test_least_matches_keeps_similar_pairs():
    for n, least in jaccard.LEAST:
        assert 0 < least < 0.8 * n


# -- contamination ------------------------------------------------------------

def test_contamination(spark, documents):
    rng = random.Random(9)
    items = [(i, " ".join(words_of(rng, n))) for i, n in enumerate([40, 15, 13, 12, 7, 4, 300])]
    items += [(7, None), (8, ""), (None, " ".join(words_of(rng, 20)))]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def around(text):
        return " ".join(words_of(rng, 50)) + " " + text + " " + " ".join(words_of(rng, 50))

    def replaced(text, every):
        w = text.split()
        w[3::every] = ["other"] * len(w[3::every])
        return " ".join(w)

    text = dict(items)
    rows = [(100, around(text[0])), (101, around(text[1].upper().replace(" ", ", "))),
            (102, around(replaced(text[0], 6))), (103, around(replaced(text[0], 2))),
            (104, around(text[3])), (105, around(replaced(text[3], 6))), (106, around(text[4])),
            (107, around(text[5])), (108, around(replaced(text[6], 7))), (109, around("")),
            (110, " ".join(text[6].split()[100:130])), (111, " ".join(text[6].split()[100:110])),
            (112, text[2]), (113, around(text[None])), (114, around(text[0]) + " " + text[1]),
            (115, text[5].upper()), (116, text[5] + " more"), (117, around(replaced(text[4], 9))),
            (118, around(replaced(text[4], 2))),
            (100, around(text[0]))] + [r for r in EDGES if r[0] != 5]
    df = documents(rows)
    got = contamination.find_overlaps(df, benchmark)
    found = sorted((r["doc_id"], repr(r["item_id"]), r["n_words"]) for r in got.collect())
    want = [(100, "0", 40), (100, "0", 40), (101, "1", 15), (102, "0", 40), (104, "3", 12),
            (105, "3", 12), (106, "4", 7), (115, "5", 4), (108, "6", 300), (110, "6", 30), (112, "2", 13), (113, "None", 20),
            (117, "4", 7), (114, "0", 40), (114, "1", 15)]
    assert found == sorted(want)
    kept = contamination.drop_contaminated(df, benchmark)
    assert kept.columns == df.columns
    assert sorted(repr(r["doc_id"]) for r in kept.collect()) == sorted(
        repr(d) for d, _ in rows if d not in {w[0] for w in want})
    assert contamination.find_overlaps(documents([]), benchmark).count() == 0
    assert contamination.find_overlaps(df, benchmark.limit(0)).count() == 0


def test_a_long_item_has_one_row_of_words(spark, documents):
    """Seeds don't carry the item: 20,000 words are 80,000 seeds of a few bytes."""
    rng = random.Random(10)
    long = " ".join(words_of(rng, 20_000))
    benchmark = spark.createDataFrame([(1, long), (2, long)], "item_id long, text string")
    items = contamination.item_words(benchmark, "item_id", "text")
    seeds = contamination.item_seeds(items)
    assert items.count() == 2 and "words" not in seeds.columns
    assert seeds.count() == 2 * sum(20_000 - len(m) + 1 for m in contamination.MASKS)
    rows = [(1, "other " * 40 + " ".join(long.split()[5000:5030])), (2, " ".join(words_of(rng, 50)))]
    got = contamination.find_overlaps(documents(rows), benchmark).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(1, 1), (1, 2)]
    assert all(r["n_equal"] >= 30 and r["item_start"] <= 5000 for r in got)


@pytest.mark.parametrize("words,replaced", [(13, 2), (15, 3), (20, 4), (5, 1), (6, 1), (9, 1), (10, 2), (12, 2)])
def test_some_seed_survives_every_replacement(words, replaced):
    places = [frozenset(at + i for i, c in enumerate(m) if c == "1")
              for m in contamination.masks_for(words) for at in range(words - len(m) + 1)]
    for gone in combinations(range(words), replaced):
        assert any(p.isdisjoint(gone) for p in places), gone


def test_longest_overlap_against_all_stretches():
    rng = np.random.default_rng(1)
    for _ in range(200):
        equal = rng.random(rng.integers(1, 30)) < 0.75
        best = max(((j - i) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)
                    if 5 * equal[i:j].sum() >= 4 * (j - i)), default=0)
        start, end = contamination.best_overlap(equal, 0.8)
        assert end - start == best


# -- toxicity -----------------------------------------------------------------

def toxic_rows(rng, n):
    rows, labels = [], []
    for d in range(1000, 1000 + n):
        own, bad = words_of(rng, rng.randrange(10, 60), 20), d % 3 == 0
        if bad:
            own[rng.randrange(len(own))] = rng.choice(["grobniksal", "blumferating", "skwarlish"])
        rows.append((d, " ".join(own)))
        labels.append((d, int(bad)))
    return rows, labels


def test_toxicity(spark, documents):
    rows, labels = toxic_rows(random.Random(3), 400)
    table = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    df = documents(rows + [r for r in EDGES if r[0] not in (4, 7)])
    got = {r["doc_id"]: r for r in toxicity.score_documents(df, table).collect()}
    tested = [(got[d], y) for d, y in labels if got[d]["held_out"]]
    assert len(tested) > 50
    assert np.mean([r["predicted"] == y for r, y in tested]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[1]["predicted"] == got[2]["predicted"] == 0
    clean = " ".join(words_of(random.Random(5), 3000, 20))
    spelt = documents([(1, clean + " grobnikssal " + clean), (2, clean)])
    model = toxicity.train(df, table)
    score = toxicity.scorer(model, spark)
    values = {r[0]: r[1] for r in spelt.select("doc_id", score("text")).collect()}
    assert values[1] > 0.5 > values[2]  # an unseen spelling in a long text
    kept = toxicity.drop_toxic(df, table)
    assert kept.columns == df.columns and kept.count() == sum(
        not got[d]["predicted"] for d, _ in rows + [r for r in EDGES if r[0] not in (4, 7)])
    assert toxicity.score_documents(documents([]), table).count() == 0
    assert toxicity.score_documents(df, table.limit(0)).filter("predicted = 1").count() == 0


def test_copies_do_not_fill_the_fit_sample(spark, documents, monkeypatch):
    texts = [f"text number {i}" for i in range(60)]
    hashed = spark.createDataFrame([(t,) for t in texts], "text string").orderBy(
        toxicity.F.xxhash64("text"))
    ordered = [r["text"] for r in hashed.collect()]
    first = {0: ordered[0], 1: ordered[1]}  # of the lowest hash in their class
    rows = [(i, t) for i, t in enumerate(ordered[2:])]
    labels = [(i, i % 2) for i, _ in rows]
    for i in range(100, 300):
        rows.append((i, first[i % 2]))
        labels.append((i, i % 2))
    rows += rows[:3]  # an id with its text twice
    given = []
    monkeypatch.setattr(toxicity, "fit", lambda *a: given.append(a))
    toxicity.train(documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int"),
                   fit_rows=10)
    chosen, toxic = given[0]
    for value in (0, 1):
        own = [t for t, y in zip(chosen, toxic) if y == value]
        assert len(own) == len(set(own)) == 10 and first[value] in own


# -- urls ---------------------------------------------------------------------

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/")]


def slow_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))
    fit = [(len(r), r, v) for v, r in RULES
           if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0]))
           and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, *(max(fit)[1:] if fit else (None, None))


def test_urls(spark):
    rng = random.Random(2)
    fixed = [None, "", "no scheme", "http://", "https://a.COM", "https://a.COM/", "x://example.com/en/",
             "http://m.example.com/en/1", "http://www.example.com/en/1", "http://www.example.com/enx",
             "http://notexample.com/en/", "http://n.net/es/?a=b#c", "http://n.net?x=/es/", "://com/",
             "http://ÄB.net/es/é", "http://a.org/x?u=http://b.com/", "HTTP://a.org#com/"]
    pages = [(i, u) for i, u in enumerate(fixed)] + [(0, fixed[8]), (None, fixed[7])]
    labels = []
    for i in range(100, 600):
        bad = rng.random() < 0.3
        site = rng.choice(["cheap-pills", "free-bets"]) if bad else rng.choice(["garden", "news"])
        pages.append((i, f"https://{site}{rng.randrange(40)}.example.org/{site}/{rng.randrange(99)}?ref=1"))
        labels.append((i, bad))
    table = spark.createDataFrame([*labels[:400], (None, True), (3, None)], "id long, blocked boolean")
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("tokens", F.lit(1))
    judged = urls.judge(df, table, RULES)
    got = sorted(map(repr, (tuple(r)[:5] for r in judged.collect())))
    truth = dict(labels)
    want = []
    for i, u in pages:
        host, path, rule, verdict = slow_rule(u)
        want.append((i, host, path, rule, verdict or ("block" if truth.get(i) else "allow")))
    assert got == sorted(map(repr, want))
    matched = judged.filter("match IS NOT NULL").select("match.rule_tokens", "match.confidence").collect()
    assert matched and all(r["confidence"] >= urls.MIN_CONFIDENCE for r in matched)
    assert urls.judge(df.limit(0), table, RULES).count() == 0
    assert urls.judge(df, table.limit(0), []).filter("verdict = 'block'").count() == 0


def test_every_matching_rule_is_found(spark):
    """Against a scan of all rules for each url."""
    rng = random.Random(12)
    names = [f"path:{c}" for c in "abcdefgh"]
    sets = [sorted(rng.sample(names, rng.randrange(0, 7))) for _ in range(80)]
    rules = [(rng.sample(names, rng.randrange(1, 4)), rng.random(), 0.1) for _ in range(12)]
    pages = spark.createDataFrame([(s,) for s in sets], "tokens array<string>")
    table = spark.createDataFrame(rules, "rule_tokens array<string>, confidence double, support double")
    got = {tuple(r["tokens"]): r["match"]["confidence"] for r in urls.matches(pages, table).collect()}
    want = {}
    for s in sets:
        fit = [c for r, c, _ in rules if set(r) <= set(s)]
        if fit:
            want[tuple(s)] = max(fit)
    assert got == want


# -- archives -----------------------------------------------------------------

def test_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rng = random.Random(1)
    bodies = ["<p>" + "x" * 150 + "</p>", "y" * 100, "z" * 99, "short", "", None,
              "é" * 60 + "\r\n\r\nWARC/1.1\r\n", "😀" * 300, "q" * 200_000]
    pages = [(i, rng.choice(["http://a.org/x", "https://b.com/a b\n", None, ""]), rng.choice(bodies))
             for i in range(60)] + [(7, "http://a.org/", bodies[0]), (None, "http://c.d/", "once" * 40)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    old = warc.write_arc(df)
    assert old.count() > 4
    files = warc.convert_archives(old)
    records = warc.read_archives(files)
    got = warc.with_referred_rows(records).collect()
    first = {}
    for i, _, html in pages:
        body = (html or "").encode()
        if i is not None and len(body) >= 100:
            first[body] = min(first.get(body, i), i)
    want = []
    seen = Counter()
    for i, _, html in pages:
        body = (html or "").encode()
        repeat = len(body) >= 100 and i is not None and (first[body] != i or seen[(i, body)])
        if first.get(body) == i:
            seen[(i, body)] += 1
        want.append((i, len(body), hashlib.sha256(body).hexdigest(),
                     "revisit" if repeat else "response", first[body] if repeat else None))
    assert sorted(map(repr, ((r["row_id"], r["payload_bytes"], r["payload_digest"],
                              r["record_type"], r["refers_to"]) for r in got))) == \
        sorted(map(repr, want))
    kept = records.filter("record_type = 'response'").select("row_id", "payload").collect()
    assert all(bytes(r["payload"]) in {(h or "").encode() for _, _, h in pages} for r in kept)
    assert records.select("record_id").distinct().count() == len(pages)
    nothing = warc.convert_archives(warc.write_arc(df.limit(0)))
    assert warc.with_referred_rows(warc.read_archives(nothing)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    import gzip
    import io
    body = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\npayload\nwith lines\n"
    data = warc.version_block(version, "old", "19970101000000") + warc.arc_record(
        version, {"URL": "http://a/b", "IP-address": "1.2.3.4", "Archive-date": "19970102030405",
                  "Content-type": "text/html"}, body) + warc.arc_record(
        version, {"URL": "dns:a", "IP-address": "1.2.3.4", "Archive-date": "19970102",
                  "Content-type": "text/dns"}, b"a 1.2.3.4")
    first, second = warc.read_arc(gzip.open(io.BytesIO(data)))
    assert (first.url, first.ip, first.payload) == ("http://a/b", "1.2.3.4", b"payload\nwith lines\n")
    assert warc.timestamp(first.date) == "1997-01-02T03:04:05Z"
    assert warc.timestamp(second.date) == "1997-01-02T00:00:00Z"
    text = gzip.decompress(warc.convert(second, None)).decode()
    assert "WARC-Type: resource" in text and "Content-Type: text/dns" in text
    with pytest.raises(EOFError):
        list(warc.read_arc(io.BytesIO(gzip.decompress(data)[:-5])))
