"""The ten operators beside small direct versions, and on odd inputs."""

import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from credscan.llm import (
    chat, contamination, divergence, interpolation, language, line_dedup, near_dup, packing, pages, token_counts,
)
from credscan.llm.cluster import components
from credscan.llm.queries import tokenizer
from credscan.llm.words import shingles, word_hashes

LOW = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, row string, text_hash string, found string, kept int, node int"


def words(text, pattern=r"[^\x20\x09-\x0D]+", lower=True):
    text = text or ""
    return re.findall(pattern, text.translate(LOW) if lower else text)


def sentences(rng, n, vocabulary=300):
    return " ".join(f"w{min(int(rng.expovariate(0.02)), vocabulary)}" for _ in range(n))


def frame(spark, rows):
    """Documents with columns named as the operators name theirs."""
    return spark.createDataFrame([(i, t, lang, "s", "r", "h", "f", 1, 2) for i, t, lang in rows], SCHEMA)


ODD = [
    (None, "nobody knows the number of this row at all", "en"), (7, None, "en"), (8, "", None), (9, " \t\n \n", "en"),
    (10, "one", "en"), (11, "One", "en"), (12, "same text in two rows of one number", "en"),
    (12, "same text in two rows of one number", "en"), (13, "...,,,!!!", "xx"), (-5, "Ünïcödé ẞ İ  \x00 \U0001f600 word", "de"),
    (14, "long " * 60_000, "en"), (15, "x" * 300_000, "en"),
]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    texts = [sentences(rng, rng.randint(1, 120)) for _ in range(60)]
    for i in range(25):  # near copies, and lines shared among documents
        own = rng.choice(texts).split()
        for _ in range(1 + len(own) // 60):
            own[rng.randrange(len(own))] = f"new{i}"
        texts.append(" ".join(own))
    texts += [f"{rng.choice(texts)}\nThis very line comes again and again.\n{sentences(rng, 9)}" for _ in range(15)]
    texts += texts[:10]
    return [(i, t, "en") for i, t in enumerate(texts)] + ODD


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def test_word_hashes_and_shingles():
    texts = ["Ab c  ab", "", None, "ab\nC", "x" * 5_000_000, "ab c ab c"]
    hashes, bounds = word_hashes(pa.array(texts))
    assert np.diff(bounds).tolist() == [3, 0, 0, 2, 1, 4]
    ab, c = hashes[:2]
    assert hashes[[2, 3, 6, 8]].tolist() == [ab] * 4 and hashes[[4, 7, 9]].tolist() == [c] * 3 and len(set(hashes.tolist())) == 3
    values, bounds = shingles(hashes, bounds, 2)
    assert np.diff(bounds).tolist() == [2, 0, 0, 1, 1, 3]
    assert values[[0, 2, 4, 6]].tolist() == [values[0]] * 4 and values[1] == values[5] and len(set(values.tolist())) == 3


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    touched = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in touched}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_interpolation(spark, rows, monkeypatch):
    kept = {}
    learned = interpolation.learned
    monkeypatch.setattr(interpolation, "learned", lambda *a: kept.setdefault("w", learned(*a)))
    got = interpolation.scores(frame(spark, rows)).collect()
    tokens = [(k, [*words(t), "</s>"]) for k, t, _ in rows]
    held = {k: zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in tokens}
    one, two = Counter(), Counter()
    for k, x in tokens:
        if not held[k]:
            one.update(x)
            two.update(zip(["<s>", *x], x, strict=False))
    n, v = sum(one.values()), len(one)
    want = []
    for k, x in tokens:
        score = 0
        for before, w in zip(["<s>", *x], x, strict=False):
            c = one["</s>"] if before == "<s>" else one[before]
            weights = kept["w"][0 if c == 0 else 1 + int(math.log2(c))]
            score += math.log10(weights[0] * (two[before, w] / c if c else 0) + weights[1] * one[w] / n + weights[2] / (v + 1))
        base = sum(math.log10((one[w] + 1) / (n + v + 1)) for w in x)
        want.append((k, held[k], len(x), sum(one[w] > 0 for w in x), n, pytest.approx(base), pytest.approx(score)))
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert np.allclose(kept["w"].sum(1), 1) and (kept["w"] >= 0).all()
    assert interpolation.scores(frame(spark, [])).count() == 0
    alone = interpolation.scores(frame(spark, [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), "a b", "en")])).first()
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0 and alone["base_score"] == 0 and alone["score"] == 0


def plain_components(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(docs, rows, width):
    def shingled(text):
        w = words(text)
        return frozenset([tuple(w)] if 0 < len(w) < width else zip(*[w[i:] for i in range(width)], strict=False))

    sets = [shingled(t) for _, t, _ in rows]
    links = [
        (i, j) for i, j in itertools.combinations(range(len(rows)), 2)
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])
    ]
    root = plain_components(range(len(rows)), links)
    least = {}
    for i, (k, _, _) in enumerate(rows):
        if k is not None:
            least[root[i]] = min(k, least.get(root[i], k))
    want = [(k, len(sets[i]), least.get(root[i]), k == least.get(root[i])) for i, (k, _, _) in enumerate(rows)]
    found = near_dup.near_duplicates(docs, width)
    got = [tuple(r) for r in found.select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    if width == 5:
        left = near_dup.drop_near_duplicates(docs, width)
        assert left.columns == docs.columns
        assert left.count() == len({root[i] for i in range(len(rows)) if sets[i]}) + sum(not s for s in sets)


def test_near_duplicates_of_an_original_with_many_copies(spark):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(40)]
    texts = [" ".join(base)]
    for i in range(60):  # each close to the original, hardly to one another
        own = list(base)
        for k in rng.sample(range(1, 39, 3), 2):
            own[k] = f"c{i}x{k}"
        texts.append(" ".join(own))
    got = near_dup.near_duplicates(frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), 2).collect()
    assert {r["component_id"] for r in got} == {0}
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


def test_near_duplicates_of_a_group_with_few_links(spark):
    """Most alterations are a copy's own, some are shared: the links left after an original's own are found."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(90):
        own = list(base)
        for k in rng.sample(range(60), rng.randrange(1, 12)):
            own[k] = f"c{i}x{k}" if i % 3 else f"s{k}"
        texts.append(" ".join(own))
    sets = [set(zip(w, w[1:], strict=False)) for w in map(str.split, texts)]
    links = [(i, j) for i, j in itertools.combinations(range(90), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = plain_components(range(90), links)
    assert 1 < len(set(root.values())) < 90
    got = near_dup.near_duplicates(frame(spark, [(i, t, "en") for i, t in enumerate(texts)]), 2).collect()
    least = {}
    for i in range(90):
        least.setdefault(root[i], i)
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: least[root[i]] for i in range(90)}


def test_line_groups(spark, rows):
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    groups = line_dedup.line_groups(frame(spark, rows)).collect()
    texts = {k: t or "" for k, t, _ in rows}
    same = defaultdict(set)
    for r in groups:
        line = texts[r["doc_id"]].split("\n")[r["line_no"]]
        own = " ".join(words(line, r"[0-9a-z\x80-\U0010ffff]+"))
        assert len(own.split()) >= line_dedup.MIN_WORDS
        same[own].add(r["group"])
    assert all(len(g) == 1 for g in same.values())  # equal normalised lines are in one group
    expected = {
        (k, i) for k, t, _ in rows for i, line in enumerate((t or "").split("\n"))
        if len(words(line, r"[0-9a-z\x80-\U0010ffff]+")) >= line_dedup.MIN_WORDS
    }
    assert {(r["doc_id"], r["line_no"]) for r in groups} == expected
    kept = Counter(r["group"] for r in {(r["group"], r["doc_id"], r["line_no"], r["kept"]): r for r in groups}.values() if r["kept"])
    assert set(kept.values()) == {1} and set(kept) == {r["group"] for r in groups}


def test_line_dedup_counts_the_words_of_every_text(spark):
    docs = frame(spark, [(i, f"common w{i}", "en") for i in range(40)])
    counted = Counter(line_dedup._levels(docs).tolist())
    # a place may hold two words, so only the commonest word's level is sure
    assert max(counted) == int(8 * math.log2(41)) and sum(n for level, n in counted.items() if level) >= 35


def test_drop_lines(spark):
    line = "the quick brown fox jumps over the lazy dog and runs far away from here"
    near = line.replace("quick", "quicker")
    rows = [(1, f"first alone\n{line}\n\nend", "en"), (2, f"{line.upper()}!\nother words stay where they are now", "en"), (3, f"  {near}", "en"), (4, line, "en"), (4, line, "en"), (5, None, "en"), (6, "", "en")]
    got = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.drop_lines(frame(spark, rows)).select("row.doc_id", "text", "n_lines", "n_removed").where("text IS NOT NULL").collect())
    assert got[0] == (1, f"first alone\n{line}\n\nend", 4, 0)
    assert got[1] == (2, "other words stay where they are now", 2, 1)
    assert got[2][0] == 3 and got[3:] == [(4, "", 1, 1), (4, "", 1, 1), (6, "", 1, 0)]
    assert line_dedup.drop_lines(frame(spark, [])).count() == 0


def test_simhash_is_close_for_close_lines():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    other = base.copy()
    other[7] ^= np.uint64(12345)
    marks = line_dedup.simhash(np.concatenate([base, other, rng.integers(0, 1 << 63, 60).astype(np.uint64)]), np.array([0, 60, 120]))
    distance = lambda a, b: int(np.unpackbits(marks[a] ^ marks[b]).sum())
    assert distance(0, 1) < 40 < 90 < distance(0, 2)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_fuzzy_lines_against_edit_similarity(spark):
    """Lines with one changed word in about fifteen, of all usual lengths, and letters changed in short lines."""
    rng = random.Random(5)
    common = "the of and to in is that it was for".split()
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    lines = []
    for n in [5, 6, 8, 10, 12, 16, 20, 30, 50, 80] * 12:
        own = [rng.choice(common) if rng.random() < 0.3 else word() for _ in range(n)]
        other = list(own)
        for at in rng.sample(range(n), max(1, n // 15)):
            other[at] = word() if n > 10 else other[at][:-1] + "q"
        lines += [" ".join(own), " ".join(other)]
    links = [
        (i, j) for i, j in itertools.combinations(range(len(lines)), 2)
        if lines[i] != lines[j] and 10 * min(map(len, (lines[i], lines[j]))) >= 9 * max(map(len, (lines[i], lines[j])))
        and len(set(lines[i].split()) & set(lines[j].split())) * 2 >= len(set(lines[i].split()))
        and 10 * edits(lines[i], lines[j]) <= max(len(lines[i]), len(lines[j]))
    ]
    groups = {r["doc_id"]: r["group"] for r in line_dedup.line_groups(frame(spark, [(i, t, "en") for i, t in enumerate(lines)])).collect()}
    assert len(links) > 90
    missed = [(i, j) for i, j in links if groups[i] != groups[j]]
    assert not missed
    whole = plain_components(set(range(len(lines))), [(i, j) for i, j in itertools.combinations(range(len(lines)), 2) if (i, j) in set(links) or lines[i] == lines[j]])
    assert len(set(groups.values())) == len(set(whole.values()))  # nothing else is linked


def test_lists_are_dealt_in_shares_and_give_every_close_pair():
    """Each pass takes its share of the values; together they give the pairs that brute force gives, copies of one line aside."""
    rng = np.random.default_rng(3)
    marks = rng.integers(0, 256, (60, 32)).astype(np.uint8)
    marks[30:] = marks[:30]
    marks[30:, :10] ^= rng.integers(0, 256, (30, 10)).astype(np.uint8) & 0x11
    size = np.tile(rng.integers(30, 90, 30), 2)
    rare = [[int(k) % 7, 100 + int(k) % 3] for k in np.tile(np.arange(30), 2)]
    columns = [pa.array(range(60)), pa.array(size), *map(pa.array, marks.view(np.int64).T), pa.array(rare, pa.list_(pa.int64()))]
    batch = pa.record_batch(columns, ["node", "size", *line_dedup.SIMHASH, "rare"])
    shares = [list(line_dedup._entries(iter([batch]), k)) for k in range(line_dedup.PASSES)]
    dealt = [sum(b.num_rows for b in share) for share in shares]
    assert sum(dealt) == 60 * (line_dedup.BLOCKS + 2) and max(dealt) < 0.5 * sum(dealt)
    got = {(r["x"], r["y"]) for share in shares for b in line_dedup._meetings(iter(share), False) for r in b.to_pylist()}
    far = np.unpackbits(marks[:, None] ^ marks[None], axis=2).sum(2)
    assert got == {
        (i, j) for i, j in itertools.combinations(range(60), 2)
        if far[i, j] <= line_dedup.FAR and 10 * min(size[i], size[j]) >= 9 * max(size[i], size[j]) and set(rare[i]) & set(rare[j])
    }
    assert len(got) >= 30 and not list(line_dedup._meetings(iter([]), False))


def test_middles():
    draw = random.Random(1)
    for _ in range(3000):
        x, y = (" ".join(draw.choices(["a", "bb", "abc", "b"], k=draw.randint(1, 7))) for _ in range(2))
        own, other, cost = line_dedup.middles(x, y)
        assert edits(own, other) == edits(x, y) <= cost


def test_lines_of_a_large_group_with_few_links(spark):
    """Copies of one line, so many that a list meets its leaders first, and copies too far from all but one another."""
    rng = random.Random(12)
    base = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(40)]

    def altered(words, n):
        words = list(words)
        for k in rng.sample(range(40), n):
            words[k] = "".join(rng.choices("0123456789", k=5))
        return words

    lines = [base, *(altered(base, rng.randint(1, 4)) for _ in range(230))]
    far = [altered(base, 9) for _ in range(6)]
    lines += [x for one in far for x in (one, altered(one, 1))]
    batch = pa.record_batch([pa.array(range(243)), pa.array([0] * 243), pa.array([" ".join(x) for x in lines])], ["doc_id", "text_hash", "text"])
    found = pa.Table.from_batches(line_dedup._lines(iter([batch]), np.zeros(1 << line_dedup.PLACE_BITS, np.uint8)))
    entries = found.append_column("node", found["doc_id"]).combine_chunks().to_batches()
    met = [pa.Table.from_batches(line_dedup._meetings(line_dedup._entries(iter(entries), k), False)) for k in range(line_dedup.PASSES)]
    assert sum(t["value"].length() - t["value"].null_count for t in met) > 200  # some lists are left to a second meeting
    groups = {r["doc_id"]: r["group"] for r in line_dedup.line_groups(frame(spark, [(i, " ".join(x), "en") for i, x in enumerate(lines)])).collect()}
    assert len({groups[i] for i in range(231)}) == 1 and len(set(groups.values())) == 7
    assert all(groups[i] == groups[i + 1] for i in range(231, 243, 2))


def test_pairs_of_two_components_are_confirmed_by_the_closest_one(spark, monkeypatch):
    """Of the pairs of a group in a few components only some have their edit distance taken."""
    rng = random.Random(8)
    base = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(40)]
    lines = []
    for _ in range(10):
        one = list(base)
        one[rng.randrange(40)] = "".join(rng.choices("0123456789", k=5))
        for _ in range(6):
            lines.append(list(one))
            lines[-1][rng.randrange(40)] = "".join(rng.choices("0123456789", k=5))
    lines.append([base[0], *("".join(rng.choices("klmnopqrst", k=5)) for _ in range(39))])
    written = []

    def counted(df, cut=line_dedup.cut):
        df = cut(df)
        written.append((df.columns, df.count()))
        return df

    monkeypatch.setattr(line_dedup, "cut", counted)
    groups = {r["doc_id"]: r["group"] for r in line_dedup.line_groups(frame(spark, [(i, " ".join(x), "en") for i, x in enumerate(lines)])).collect()}
    assert len({groups[i] for i in range(60)}) == 1 and groups[60] != groups[0]
    assert sum(n for columns, n in written if columns == ["x", "y", "far"]) > 1000 > 2 * sum(n for columns, n in written if columns == ["x", "y"])


@pytest.mark.parametrize("steps", [3, 32])
def test_edits_within(monkeypatch, steps):
    """Edit distances of whole batches are those of brute force, for texts of all lengths, also outside the basic plane."""
    monkeypatch.setattr(line_dedup, "STEPS", steps)
    draw, rows = random.Random(9), [("", "", 0), ("", "ab", 1), ("", "ab", 2), ("😀a", "a", 1), ("😀", "😁", 0)]
    for k in range(1500):
        letters = "abé😀" if k < 300 else "abé"
        one = draw.choices(letters, k=draw.randint(0, 60 if k % 9 == 0 else 20))
        two = list(one)
        for _ in range(draw.randint(0, 6)):
            at, kind = draw.randint(0, len(two)), draw.random()
            two[at : at + (kind > 0.3)] = draw.choices(letters, k=kind < 0.7)
        rows.append(("".join(one), "".join(two), draw.randint(0, 9)))
    for part in (rows, rows[300:], rows[:0]):
        x, y, most = ([r[i] for r in part] for i in range(3))
        got = line_dedup.edits_within(pa.array(x, pa.string()), pa.array(y, pa.string()), np.array(most, np.int32))
        assert got.tolist() == [edits(a, b) <= n for a, b, n in part]
    assert got.size == 0


def test_rarest_words():
    """Lines that differ in ``changes`` words share one of their rarest, whatever the order of words is."""
    rng = np.random.default_rng(4)
    levels = rng.integers(0, 256, 1 << line_dedup.PLACE_BITS).astype(np.uint8)
    for n in (5, 9, 30, 100):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2)
        size = np.array([6 * n, 6 * n])
        far = line_dedup.changes(np.array([n]), size[:1])[0]
        assert far >= min(3, 6 * n // 9)
        b = a.copy()
        b[rng.permutation(n)[:far]] += np.uint64(1)
        found, bounds = line_dedup.rarest(np.concatenate([a, b]), np.repeat([0, 1], n), size, levels)
        assert list(np.diff(bounds)) == [far + 1, far + 1]
        assert set(found[: far + 1]) & set(found[far + 1 :])


def test_lines_of_scripts_without_spaces(spark):
    rng = random.Random(6)
    han, thai = ["".join(chr(rng.randrange(low, high)) for _ in range(40)) for low, high in ((0x4E00, 0x9000), (0x0E01, 0x0E2F))]
    other = "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(40))
    rows = [(1, han), (2, f"一{han[1:20]}二{han[21:]}"), (3, other), (4, thai), (5, f"{thai[:9]}{thai[10:]}"), (6, "四个字的"), (7, "四个字的"), (8, "x" * 90), (9, "x" * 90)]
    groups = {r["doc_id"]: r["group"] for r in line_dedup.line_groups(frame(spark, [(i, t, "zh") for i, t in rows])).collect()}
    assert set(groups) == {1, 2, 3, 4, 5}
    assert groups[1] == groups[2] and groups[4] == groups[5] and len(set(groups.values())) == 3


def test_parted():
    texts = ["a中b 文字c", "", None, "ขa é Ⴀ ក", "𠀀x", "일 이 😀", "中"]
    data, starts, ends, _ = line_dedup.word_spans(pa.array(texts), alphanumeric=True)
    begins, stops, unspaced = line_dedup.parted(data, starts, ends)
    got = [bytes(data[i:j]).decode() for i, j in zip(begins, stops, strict=True)]
    assert got == ["a", "中", "b", "文", "字", "c", "ข", "a", "é", "Ⴀ", "ក", "𠀀", "x", "일", "이", "😀", "中"]
    assert [t for t, u in zip(got, unspaced, strict=True) if u] == ["中", "文", "字", "ข", "ក", "𠀀", "中"]


def test_html_blocks():
    page = (
        "<!DOCTYPE html><title>no <b>t</b></title><script>var a='</p>'</script><nav><a href=/x>Menu</a></nav><article><h1>A &amp; B</h1>"
        "<p>One <i>t</i>wo<br>three &lt;4<p>un<b>closed <!-- c > d --> x<ul><li>i<li>j</ul><a title='>'>k</a></article>5 < 6"
    )
    assert [b.text for b in pages.blocks(page)] == ["Menu", "A & B", "One two three <4", "unclosed x", "i", "j", "k", "5 < 6"]
    assert pages.blocks(page)[3].path == ["article", "p", "b"] or pages.blocks(page)[3].path == ["article", "p"]
    assert pages.blocks("") == [] and pages.blocks("<p>" * 1000) == [] and pages.blocks("<script>x") == []

    def texts(page):
        return [b.text for b in pages.blocks(page)]

    # tags that are left open, or stand for other content, take no text with them
    for tag in ("<object data=x>", "<canvas/>", "<iframe src=x>", "<noscript>", "<template>", "<svg>", "<textarea>", "<math>"):
        assert texts(f"<article><p>one</p>{tag}<p>two</article>") == ["one", "two"]
    assert texts("<p>E=<math><mi>m</mi></math> ok</p>") == ["E=m ok"]
    assert texts("<p>a<object><p>b</p></object><iframe>c</iframe><svg><title>d</title></svg><canvas>e</canvas></p>") == ["a", "b", "e"]
    names = {*pages.FURNITURE, *pages.CONTENT, *(f".{x}" for x in (*pages.NOISE, *pages.MAIN))}
    assert len({pages._hash(x) for x in names}) == len(names)


def test_labeller_gradients():
    rng = np.random.default_rng(2)
    model = pages.Labeller(inputs=5, hidden=3)
    model.weights = {k: rng.normal(0, 0.5, v.shape) for k, v in model.weights.items()}
    x, mask = pages.padded([rng.normal(size=(4, 5)), rng.normal(size=(2, 5))])
    labels = (rng.random(mask.shape) < 0.5).astype(float)

    def loss():
        p = model.probabilities(x, mask)[0]
        return -(np.where(labels > 0, np.log(p), np.log(1 - p)) * mask).sum() / mask.sum()

    for name, g in model.gradients(x, mask, labels).items():
        at = tuple(int(rng.integers(n)) for n in model.weights[name].shape)
        before = model.weights[name][at]
        ends = []
        for d in (1e-3, -1e-3):
            model.weights[name][at] = before + d
            ends.append(loss())
        model.weights[name][at] = before
        assert (ends[0] - ends[1]) / 2e-3 == pytest.approx(g[at], abs=2e-4)


def test_main_text(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/pages.parquet")
    odd = spark.createDataFrame([(None, None, None), (-1, "u", ""), (-2, "u", "<nav>menu</nav>"), (-3, "u", "< < &")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in pages.extracted(table.union(odd).withColumn("text", F.lit("x"))).collect()}
    right = 0
    raw = {r["page_id"]: r["html"] for r in table.collect()}
    for k, page in raw.items():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
        parts = [" ".join(pages.html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        right += got[k][0] == "\n".join(x for x in parts if x)
        assert got[k][1] == len(got[k][0])
    assert right == len(raw) and got[None] == got[-1] == got[-2] == ("", 0)
    assert pages.extracted(table.limit(0)).count() == 0


def test_contained(spark, rows):
    def shingled(text):
        w = words(text, r"[0-9a-z\x80-\U0010ffff]+")
        return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    rng = random.Random(4)
    long = sentences(rng, 20_000, 10**6)
    items = [(i, sentences(rng, rng.randint(1, 60))) for i in range(12)] + [(50, None), (51, ""), (None, rows[3][1]), (52, rows[0][1]), (52, rows[0][1]), (53, "one")]
    own = [*rows, *[(1000 + i, f"{long[: 3000 * i]} {t.upper()}!!  {long[3000 * i :]}", "en") for i, t in items[:12]]]
    want, bad = set(), set()
    for (k, t, _), (i, x) in itertools.product(own, items):
        s = shingled(x)
        n = len(s & shingled(t)) if s and len(t or "") < 250_000 else 0
        if s and 5 * n >= 4 * len(s):
            want.add((k, i, len(s), n, n / len(s)))
            bad.add((k, t))
    found = contamination.contained(frame(spark, own), spark.createDataFrame(items, "item_id long, text string"))
    got = [tuple(r) for r in found.select("doc_id", "item_id", "n_item_shingles", "n_shared", "containment").collect()]
    assert set(got) == want and len(want) > 12
    left = contamination.decontaminate(frame(spark, own), spark.createDataFrame(items, "item_id long, text string"))
    assert left.columns == frame(spark, []).columns and left.count() == sum((k, t) not in bad for k, t, _ in own)
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination.contained(frame(spark, own), none).count() == 0
    assert contamination.contained(frame(spark, []), none).count() == 0


def test_language(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(table.where(language.remainder(F.col("doc_id"), 3) != 1))
    assert 0 < (model.weights != 0).mean() < 1 and model.temperature > 0
    found = table.select("doc_id", "lang", language.identify(model, F.col("text"), spark).alias("f"))
    held = [r for r in found.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    assert sum(r["f"]["lang"] == r["lang"] for r in held) >= 0.95 * len(held)
    odd = [r["f"] for r in frame(spark, ODD).select(language.identify(model, F.col("text"), spark).alias("f")).collect()]
    assert [(r["lang"], r["score"]) for r in odd[1:4]] == [("und", 0.0)] * 3 and odd[8]["lang"] == "und"
    assert all(0 <= r["score"] <= 1 for r in odd) and odd[6] == odd[7]
    empty = language.fit(frame(spark, [(1, "text", None)]))
    assert frame(spark, ODD[:1]).select(language.identify(empty, F.col("text"), spark).alias("f")).first()["f"]["lang"] == "und"


def test_every_language_is_learned(spark):
    letters = {f"l{k}": [chr(0x3B1 + 60 * k + j) for j in range(12)] for k in range(5)}
    rng = random.Random(8)
    rows = [(i, " ".join("".join(rng.choice(letters[lang]) for _ in range(5)) for _ in range(12)), lang) for i, lang in enumerate(list(letters) * 15)]
    docs = frame(spark, rows)
    model = language.fit(docs, sample=16)
    assert model.languages == sorted(letters)
    found = docs.select("lang", language.identify(model, F.col("text"), spark)["lang"].alias("got")).collect()
    assert all(r["lang"] == r["got"] for r in found)


def test_ftrl_separates():
    rows = [(np.array([k, 5]), np.array([1.0, 0.5]), k % 3) for k in [0, 1, 2] * 20]
    weights = language.ftrl(rows, 8, 3)
    assert [int(np.argmax(v @ weights[at])) for at, v, _ in rows[:3]] == [0, 1, 2] and (weights[[3, 4, 6, 7]] == 0).all()


def test_packing(docs, rows):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer())
    got = packing.pack(packing.pieces(docs, tokenizer(), keep_ids=True)).collect()
    want = []
    for k, t, _ in rows:
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            want.append((k, piece, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes()), own))
    assert sorted([tuple(r)[:6] for r in got], key=repr) == sorted(want, key=repr)
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 2048


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(8)
    for _ in range(40):
        capacity = rng.choice([7, 20, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))] + [rng.randint(1, capacity)] * rng.randint(0, 60)
        gaps = []
        for n in sorted(lengths, reverse=True):
            fitting = [g for g in gaps if g >= n]
            if fitting:
                gaps.remove(min(fitting))
            gaps.append((min(fitting) if fitting else capacity) - n)
        plan = packing.plan(Counter(lengths), capacity)
        counts, seen, held = Counter(lengths), set(), defaultdict(list)
        rows = sorted(map(tuple, plan))
        for i, (n, rank, each, first, offset) in enumerate(rows):
            end = rows[i + 1][1] if i + 1 < len(rows) and rows[i + 1][0] == n else counts[n]
            for r in range(rank, end):
                seen.add((n, r))
                held[first + (r - rank) // each].append((offset + (r - rank) % each * n, n))
        assert len(seen) == len(lengths) and len(held) == len(gaps)
        for own in held.values():
            own.sort()
            assert [o for o, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))]
            assert sum(n for _, n in own) <= capacity


def test_token_counts(spark, rows):
    automaton = token_counts.automaton(tokenizer())
    letters = {b: c for c, b in token_counts.byte_letters().items()}
    import json

    vocabulary = set(json.load(open(tokenizer(), encoding="utf-8"))["model"]["vocab"]) - {"<|startoftext|>", "<|endoftext|>"}

    def greedy(word):
        text, n, at = "".join(letters[b] for b in word.encode()), 0, 0
        while True:
            if f"{text[at:]}</w>" in vocabulary and at < len(text):
                return n + 1
            ends = [k for k in range(len(text), at, -1) if text[at:k] in vocabulary]
            if not ends:
                return 1
            at, n = ends[0], n + 1

    table = frame(spark, [r for r in rows if len(r[1] or "") < 10_000])
    got = table.select("text", token_counts.piece_counts(F.col("text"), tokenizer()).alias("c")).collect()
    for r in got:
        own = words(r["text"])
        assert (r["c"]["n_words"], r["c"]["n_pieces"]) == (len(own), sum(map(greedy, own)))
    assert automaton.count(b"") >= 0


def test_automaton_on_random_vocabularies():
    rng = random.Random(1)

    def greedy(word, pieces):
        symbols, at, n = [*word, 256], 0, 0
        while at < len(symbols):
            ends = [k for k in range(len(symbols), at, -1) if tuple(symbols[at:k]) in pieces]
            if not ends:
                return 1
            at, n = ends[0], n + 1
        return n

    for _ in range(150):
        pieces = {tuple(rng.choices([97, 98, 99], k=rng.randint(1, 4))) + ((256,) if rng.random() < 0.4 else ()) for _ in range(rng.randint(1, 14))}
        if rng.random() < 0.6:
            pieces |= {(97,), (98,), (99,), (256,)}
        machine = token_counts.Automaton(pieces)
        some = [bytes(rng.choices([97, 98, 99], k=rng.choice([1, 3, 8, 60]))) for _ in range(20)]
        data, sizes = np.frombuffer(b" ".join(some), np.uint8), np.array([len(w) for w in some])
        starts = np.cumsum(sizes + 1) - sizes - 1
        assert machine.counts(data, starts, starts + sizes).tolist() == [greedy(w, pieces) for w in some]


def test_quality(spark, rows):
    rows = [(i, t, lang) for i, (_, t, lang) in enumerate(rows)]
    got = {}
    for r in divergence.judged(frame(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    for k, t, _ in rows:
        own = words(t, lower=False)
        windows = [tuple(own[i : i + 3]) for i in range(len(own) - 2)]
        often = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if often[w] > 1 for j in range(3)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        symbols = sum((t or "").count(c) for c in "#*$%&|<>")
        failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
        for r in got[k]:
            assert tuple(r)[1:7] == (len(own), sum(map(len, own)), symbols, len(lines) - len(set(lines)), len(covered), failed), k
            assert not (failed and r["kept"]) and 0 <= r["class_distance"] <= 1 and 0 <= r["word_distance"] <= 1


def test_distances(spark):
    rng = random.Random(6)
    rows = [(i, sentences(rng, 200, 20) + ". Ab 12!", "en") for i in range(30)] + [(99, "%% ## 77 $$ " * 30 + sentences(rng, 80, 10**6).upper(), "en")]
    got = {r["doc_id"]: r for r in divergence.judged(frame(spark, rows)).collect()}
    joined = "\n".join(t for _, t, _ in rows)
    counts = Counter(w.lower() for _, t, _ in rows for w in t.split())
    total = sum(counts.values())
    common = {w: n / total for w, n in counts.items() if n >= divergence.COMMON * total}
    kinds = [re.compile(p) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[\x20\x09-\x0D]", r"""[.,;:!?'"()\-]""", r"[^\x00-\x7F]")]

    def js(p, q):
        keys = set(p) | set(q)
        part = lambda a, b: a * math.log2(2 * a / (a + b)) if a > 0 else 0
        return math.sqrt(max(0, sum(part(p.get(k, 0), q.get(k, 0)) + part(q.get(k, 0), p.get(k, 0)) for k in keys) / 2))

    def shares(text, size):
        own = {i: len(k.findall(text)) / size for i, k in enumerate(kinds)}
        return own | {"rest": max(0.0, 1 - sum(own.values()))}

    reference = shares(joined, len(joined) - len(rows) + 1)
    reference = {k: (v if k != 3 else len(re.findall(r"[ \t-\r]", "".join(t for _, t, _ in rows))) / (len(joined) - len(rows) + 1)) for k, v in reference.items()}
    reference["rest"] = max(0.0, 1 - sum(v for k, v in reference.items() if k != "rest"))
    for k, t, _ in rows:
        own = Counter(w.lower() for w in t.split())
        n = sum(own.values())
        q = {w: own[w] / n for w in common}
        p = common | {"": max(0.0, 1 - sum(common.values()))}
        assert got[k]["word_distance"] == pytest.approx(js(p, q | {"": max(0.0, 1 - sum(q.values()))}), abs=1e-7)
        assert got[k]["class_distance"] == pytest.approx(js(reference, shares(t, len(t))), abs=1e-7)
    assert got[0]["class_distance"] < divergence.MOST_CLASS < got[99]["class_distance"] and not got[99]["kept"]


def repair_cost(roles, found):
    cost, before = 0, chat.START
    for role, state in zip(roles, found, strict=True):
        cost += chat.role_cost(role, state) + chat.place_cost(before, state)[0]
        before = state
    return cost + chat.INSERT * len(chat.closing(before))


def test_repair_is_cheapest():
    for n in range(1, 5):
        for roles in itertools.product(("system", "user", "assistant", None), repeat=n):
            best = min(repair_cost(roles, s) for s in itertools.product((1, 2, 3), repeat=n))
            assert repair_cost(roles, chat.states(list(roles))) == best
            for k in range(1, n):
                parts = [list(roles[:k]), list(roles[k:])]
                ways = chat.through([[c for s in chat.STATES for c in chat.run_costs(p, s)] for p in parts])
                found = [x for p, (a, b) in zip(parts, ways, strict=True) for x in chat.states(p, a, b)]
                assert repair_cost(roles, found) == best


def test_repaired(spark):
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool", None]), rng.choice(["a", "", None, "b\nc"])) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(500, t, rng.choice(["user", "assistant"]), f"t{t}") for t in range(400)]  # spans partitions
    rows += [(None, None, "user", "x"), (None, 1, "assistant", "y"), (600, 1, "user", "same"), (600, 1, "user", "same")]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "conv_id long, turn long, role string, text string, place string, action string")
    got = defaultdict(list)
    for r in chat.repaired(table).collect():
        got[r["conv_id"]].append(r)
    source = defaultdict(list)
    for r in rows:
        source[r[0]].append(r)
    for conv, own in got.items():
        own.sort(key=lambda r: r["place"])
        text = "".join(r["rendered"] for r in own)
        turns = [x.split("|>\n", 1) for x in text.split("<|end|>\n")[:-1]]
        roles = [x[0][2:] for x in turns]
        assert roles[0] in ("system", "user") and roles[-1] == "assistant"
        tail = roles[1:] if roles[0] == "system" else roles
        assert tail == ["user", "assistant"] * (len(tail) // 2)
        mine = sorted(source[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
        assert [r["text"] for r in own if r["action"] != "insert"] == [r[3] or "" for r in mine]
        best = repair_cost([r[2] for r in mine], chat.states([r[2] for r in mine]))
        states = [1 + chat.ROLES.index(r["role"]) for r in own if r["action"] != "insert"]
        assert repair_cost([r[2] for r in mine], states) == best
    assert len(got) == len(source) and chat.repaired(table.limit(0)).count() == 0


def test_edit_tests_of_line_dedup_equal_levenshtein(spark):
    """The shortcuts before the edit distance lose no pair and let none in."""
    draw, rows = random.Random(5), []
    for _ in range(1500):
        one = ["".join(draw.choices("abé", k=draw.randint(1, 4))) for _ in range(draw.randint(1, 9))]
        two = list(one)
        for _ in range(draw.randint(0, 3)):
            at, kind = draw.randrange(len(two)), draw.random()
            if kind < 0.35:
                two.insert(at, "ab")
            elif kind < 0.7 and len(two) > 1:
                del two[at]
            else:
                two[at] = "".join(draw.choices("abé", k=draw.randint(1, 4)))
        rows.append((" ".join(one), " ".join(two), draw.randint(0, 8)))
    found = spark.createDataFrame(rows, "x string, y string, most int").select(
        "*", line_dedup.close("x", "y", F.col("most")).alias("close"), F.expr("levenshtein(x, y) <= most").alias("wanted")
    ).collect()
    assert all(r["close"] == r["wanted"] for r in found)
    assert any(r["wanted"] for r in found) and not all(r["wanted"] for r in found)
    for r in found:
        if r["wanted"]:
            assert line_dedup.grams_apart(r["x"], r["y"], line_dedup.GRAM) <= line_dedup.GRAM * r["most"]
