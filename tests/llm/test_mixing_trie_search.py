"""Source mixing, the prefix trie and ranked search beside direct versions, and on odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from credscan.llm import mixing, prefix_trie, ranked_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


# --- mixing -----------------------------------------------------------------

#: The other columns are named as the operator names its own.
DOCS = "doc_id long, text string, source string, key string, size int, row string, cut string, same int"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "r", "c", 1) for r in rows], DOCS)


def mix_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{rng.randrange(50)}" for _ in range(rng.randint(1, 40))), f"s{min(rng.randrange(12), 5)}") for i in range(300)]
    return rows + [
        (None, "no number here", "s1"), (400, None, "s0"), (401, "", "s0"), (402, " \t\n", "only blanks"), (403, "one\x0btwo", None),
        (404, "twice the same", "s2"), (404, "twice the same", "s2"), (405, "x " * 5000, "long"), (406, "É ẞ \U0001f600", ""),
    ]


def wanted_targets(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = total - sum(most * sizes[s] for s in full)
        share = {s: Fraction(left * weight[s], sum(weight[x] for x in free)) for s in free}
        above = [s for s in free if share[s] > most * sizes[s]]
        if not above:
            return {s: Fraction(most * sizes[s]) if s in full else share[s] for s in order}
        full.update(above)


def test_mixing(spark):
    rows = mix_rows()
    found = mixing.mixed(documents(spark, rows)).cache()
    got = found.select("row.doc_id", "row.text", "row.source", "*").drop("row").collect()
    assert len(got) == len(rows) and Counter((r["doc_id"], r["text"], r["source"]) for r in got) == Counter(rows)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    targets, taken = wanted_targets(sizes), Counter()
    for r in got:
        size = len(WORD.findall(r["text"] or ""))
        assert (r["size"], r["source_size"]) == (size, sizes[r["source"]]) and 0 <= r["taken"] <= 3 * size
        assert r["target"] == pytest.approx(float(targets[r["source"]])) and r["taken"] == r["epochs"] * size + r["extra"]
        taken[r["source"]] += r["taken"]
    for source, words in taken.items():  # to the word, but for two equal rows at a cut
        assert math.floor(targets[source]) - 2 <= words <= math.ceil(targets[source])
    assert sum(targets.values()) == sum(sizes.values()) and any(targets[s] == 3 * sizes[s] for s in sizes if sizes[s])
    # in key order all before the cut are taken once more than all after it
    for source in ("s0", "s5"):
        own = sorted((hashlib.md5(f"{'' if r['doc_id'] is None else r['doc_id']}:{r['text'] or ''}".encode()).hexdigest(), r) for r in got if r["source"] == source and r["size"])
        more = [r["extra"] / r["size"] for _, r in own]
        assert more == sorted(more, reverse=True) and sum(0 < x < 1 for x in more) <= 1
    given = Counter()
    for r in mixing.texts(found).select("row.doc_id", "row.text", F.col("text").alias("part")).collect():
        assert r["text"].startswith(r["part"])
        given[r["doc_id"]] += len(WORD.findall(r["part"]))
    words = Counter()
    for r in got:
        words[r["doc_id"]] += r["taken"]
    assert given == +words


def test_mixing_without_rows_or_words(spark):
    assert mixing.mixed(documents(spark, [])).collect() == []
    got = mixing.mixed(documents(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r["size"], r["target"], r["taken"]) for r in got] == [(0, 0.0, 0)] * 2


def test_mixing_without_broadcasts(spark, monkeypatch):
    rows = [(i, "a b c " * (i % 5 + 1), "s") for i in range(200)]
    monkeypatch.setattr(mixing, "SMALL", 0)  # the way without broadcasts
    rows += [(i, "d e", "t") for i in range(1000, 1010)]
    got = mixing.mixed(documents(spark, rows), weights=(1, 1)).collect()
    taken = {s: sum(r["taken"] for r in got if r["row"]["source"] == s) for s in "st"}
    assert taken == {"s": 1760, "t": 60}


# --- trie -------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, node string, depth int, weight int, parent int, place int"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "n", 1, 2, 3, 4) for r in rows], TURNS)


def wanted_trie(rows, shared=5, heads=9):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, role, digest, text))
    own = {c: [(x[2], x[4]) for x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(own.get(c - math.fmod(c, shared), [])[:h] + turns[h:])
    nodes = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (
            min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p],
            hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))).encode()).hexdigest(),
        )
        for p, m in nodes.items()
    )


def got_trie(spark, rows):
    conversations = talk(spark, rows)
    found = prefix_trie.trie(*prefix_trie.rebuilt(prefix_trie.turns(conversations), conversations))
    return sorted(tuple(-1 if x is None else x for x in r) for r in found.collect())


def conversations():
    rng = random.Random(8)
    rows = [(c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "Größe"])) for c in range(60) for t in range(rng.randint(1, 7))]
    rows += [(100 + c, t, "user", "the same") for c in range(20) for t in range(5)]  # a hot path
    rows += [(200, t, "user", f"turn {t % 7}") for t in range(300)]  # a long one
    rows += [(301, t, "user", "short") for t in range(1)] + [(300, None, None, None), (300, 1, "user", ""), (300, 1, "user", "")]
    return rows + [(None, 1, "user", "nobody's"), (7, 2, "user", "yes"), (7, 2, "user", "yes"), (-3, 1, "user", "yes"), (-4, 1, None, "x" * 100_000)]


def test_trie(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPLIT", 60)
    monkeypatch.setattr(prefix_trie, "BLOCK", 4)
    monkeypatch.setattr(prefix_trie, "PIECE", 20)
    monkeypatch.setattr(prefix_trie, "AT_ONCE", 50)
    rows = conversations()
    assert got_trie(spark, rows) == wanted_trie(rows)


def test_trie_of_little(spark, monkeypatch):
    assert got_trie(spark, []) == []
    assert got_trie(spark, [(None, 1, "user", "x")]) == []
    # c's only turn is among its first h: a member of the root alone
    c = next(c for c in range(1, 40) if zlib.crc32(str(c).encode()) % 9 and c % 5)
    rows = [(5, 1, "user", "x"), (10, 1, "user", "x"), (20 + c, 1, "user", "x"), (c, 1, "user", "x")]
    monkeypatch.setattr(prefix_trie, "SMALL", 0)
    monkeypatch.setattr(prefix_trie, "SPLIT", 1)
    assert got_trie(spark, rows) == wanted_trie(rows)


# --- search -----------------------------------------------------------------

def terms(text):
    return TERM.findall((text or "").translate(LOW))


def wanted_search(docs, items, k):
    docs = [(i, Counter(terms(t))) for i, t in docs]
    docs = [(i, c) for i, c in docs if c]
    n_docs, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            n = sum(c.values())
            m = 75 + 25 * n * n_docs // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if t in c
            )
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


DOC = "doc_id long, text string, id int, row int, query int, term string, level int"


def search_rows():
    rng = random.Random(6)
    word = lambda: f"W{min(int(rng.expovariate(0.05)), 90)}"
    docs = [(i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(150)]
    docs += [(200 + i, docs[3][1]) for i in range(40)]  # equal scores
    docs += [(300, None), (301, ""), (302, "-- !"), (303, "w1 " * 50_000), (304, "é W2,w3;W4\x00w5"), (305, docs[5][1])]
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 25)))) for i in range(15)]
    items += [(90, docs[3][1]), (91, None), (92, "nowhere"), (93, "w1 w1 w1 W2 é"), (5, docs[7][1])]
    return docs, items


@pytest.mark.parametrize(("k", "first", "small"), [(20, 1000, 200_000), (3, 8, 0)])
def test_search(spark, monkeypatch, k, first, small):
    monkeypatch.setattr(ranked_search, "FIRST", first)
    monkeypatch.setattr(ranked_search, "SMALL", small)
    docs, items = search_rows()
    frames = spark.createDataFrame([(*d, 1, 2, 3, "t", 4) for d in docs], DOC), spark.createDataFrame(items, "item_id long, text string")
    got = ranked_search.search(*frames, k=k).collect()
    assert sorted(map(tuple, got), key=repr) == wanted_search(docs, items, k)


def test_search_closes_queries(spark, monkeypatch):
    """A query that few documents answer well makes no accumulators for its frequent terms."""
    made = []
    cut = ranked_search.cut

    def counting(df):
        out = cut(df)
        if set(out.columns) == {"query", "row", "score"}:
            made.append(out.count())
        return out

    monkeypatch.setattr(ranked_search, "cut", counting)
    monkeypatch.setattr(ranked_search, "FIRST", 4)
    docs = [(i, f"common often {'seldom rare scarce odd' if i < 4 else f'x{i}'}") for i in range(400)]
    items = spark.createDataFrame([(1, "rare seldom scarce odd often common")], "item_id long, text string")
    got = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string"), items, k=4).collect()
    assert sorted((r["rank"], r["doc_id"]) for r in got) == [(1, 0), (2, 1), (3, 2), (4, 3)] and max(made) == 4


def test_search_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert ranked_search.search(empty, items).collect() == []
    # repeated rows are documents and queries of their own
    got = ranked_search.search(docs.union(docs), items.union(items)).collect()
    assert sorted((r["item_id"], r["rank"], r["doc_id"]) for r in got) == [(1, 1, 1), (1, 1, 1), (1, 2, 1), (1, 2, 1)]
