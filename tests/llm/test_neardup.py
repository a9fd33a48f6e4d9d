import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from rulespark.llm.graph import connected_components
from rulespark.llm.neardup import link_block, near_duplicates
from rulespark.llm.substring import SPAN_BASE, repeated_paragraphs, without_repeats, without_spans
from tests.llm.fixtures import frame, odd_rows, sentence, stored

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, width=5):
    words = [w for w in re.split(r"[\x20\t-\r]+", (text or "").translate(LOWER)) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) or frozenset([tuple(words)])


def components(sets):
    """Union-find over all pairs that share enough: brute force."""
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, s in sets.items():
        for x in s:
            where[x].append(k)
    both = Counter((a, b) for own in where.values() for i, b in enumerate(own) for a in own[:i])
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {k: find(k) for k in sets}


def corpus(seed=1, groups=6, size=60):
    """Copies of copies with a few words changed, so that chains and near misses at the bound occur."""
    rng = random.Random(seed)
    out = []
    for _ in range(groups):
        family = [sentence(rng, rng.randint(6, 160)).split()]
        for _ in range(size):
            words = list(rng.choice(family))
            for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = sentence(rng, 1)
            family.append(words)
        out += [" ".join(w) for w in family]
    return [(k, t, "en", "s", len(t)) for k, t in enumerate(out)]


def test_near_duplicates_equal_brute_force(spark, tmp_path):
    rows = corpus()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(stored(spark, frame(spark, rows), tmp_path / "d")).collect()}
    sets = {r[0]: shingles(r[1]) for r in rows}
    want = components(sets)
    assert got == {k: (len(sets[k]), want[k], want[k] == k) for k in sets}


def test_near_duplicates_on_odd_rows(spark):
    rows = odd_rows()
    out = near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out if r["doc_id"] in (5, 6, 8)) == [(5, 5, True)] * 3 + [(6, 5, False), (6, 6, True), (8, 5, False)]
    assert all(r["n_shingles"] == 0 and r["kept"] for r in out if r["doc_id"] in (0, 1, 2))
    nameless = [r for r in out if r["doc_id"] is None]
    assert sorted((r["component_id"] or -1, r["kept"]) for r in nameless) == [(-1, True), (5, False)]


@pytest.mark.parametrize("split", [False, True])
def test_link_block_finds_every_link_across_parts(split):
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(40) for _ in range(30)], np.uint64)) for _ in range(40)]
    ids, parts = np.arange(40), np.array([k % 25 for k in range(40)])
    left = np.array([split and k % 2 == 0 for k in range(40)]) if split else np.ones(40, bool)
    found = link_block(ids, parts, sets, left, 60)
    root = {int(p): int(p) for p in parts}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in found:
        assert 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))
        root[max(find(int(parts[a])), find(int(parts[b])))] = min(find(int(parts[a])), find(int(parts[b])))
    for a in range(40):
        for b in range(a):
            if (not split or left[a] != left[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b])):
                assert find(int(parts[a])) == find(int(parts[b]))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (5, None), (1, 2)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 140)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_repeated_paragraphs_equal_brute_force(spark, tmp_path):
    rng = random.Random(2)
    shared = [sentence(rng, n) for n in (30, 60, 90)]
    rows = []
    for k in range(60):
        own = [sentence(rng, rng.randint(3, 70)) for _ in range(4)]
        if k % 3 == 0:
            words = rng.choice(shared).split()
            words[rng.randrange(len(words))] = "changed"
            own.insert(rng.randrange(4), " ".join(words))
        if k % 10 == 1:
            own += [own[0], ""]  # repeats within one document only
        rows.append((k, "\n".join(own), "en", "s", 1))
    found = repeated_paragraphs(stored(spark, frame(spark, rows), tmp_path / "d")).where("kind = 'paragraph'").collect()
    got = {(r["doc_id"], r["start_word"]): (r["first_doc_id"], r["first_word"], r["removed"]) for r in found}
    parts = {}
    for k, t, *_ in rows:
        at = 0
        for line in t.split("\n"):
            n = len(line.split())
            if n >= 25:
                parts[k, at] = shingles(line)
            at += n
    comp = components(parts)
    members = defaultdict(list)
    for p, c in comp.items():
        members[c].append(p)
    want = {p: (*min(own), p != min(own)) for own in members.values() if len({d for d, _ in own}) > 1 for p in own}
    assert got == want


def test_passages_in_the_middle_of_paragraphs(spark, tmp_path):
    rng = random.Random(21)

    def prose(n):
        return " ".join(w + ("." if k % 8 == 7 else "") for k, w in enumerate(sentence(rng, n).split()))

    template = prose(12)
    passages = [prose(n) for n in (55, 70, 120)]
    rows, holders = [], {}
    for k in range(90):
        words = prose(150).split()
        if k % 3 == 0:
            at = rng.randrange(len(words))
            words[at:at] = passages[k % 9 // 3].split()
            holders.setdefault(k % 9 // 3, []).append(k)
        rows.append((k, template + "\n" + " ".join(words), "en", "s", 1))
    rows += [(500, "a b c. " * 40, "en", "s", 1), (501, "x", "en", "s", 1), (None, rows[0][1], "en", "s", 1)]
    docs = stored(spark, frame(spark, rows), tmp_path / "d")
    found = repeated_paragraphs(docs).where("kind = 'passage'").collect()
    assert {r["doc_id"] for r in found} == {k for own in holders.values() for k in own}
    assert {r["doc_id"] for r in found} - {r["doc_id"] for r in found if r["removed"]} == {min(own) for own in holders.values()}
    left = {r["doc_id"]: r["text"] for r in without_repeats(docs).where("doc_id IS NOT NULL").collect()}
    for k, t, *_ in rows[:90]:
        gone = len(t.split()) - len(left[k].split())
        own = next((p for p, ids in holders.items() if k in ids and k != min(ids)), None)
        # all but the pieces that were glued to other words; the short template stays
        assert (gone == 0) if own is None else (len(passages[own].split()) - 24 <= gone <= len(passages[own].split()))
        assert left[k].startswith(template)


def covered_by_brute_force(rows, size=50):
    """(id, word) of every word in a run of ``size`` words that stands in two documents."""
    where = defaultdict(set)
    for k, t, *_ in rows:
        words = t.translate(LOWER).split()
        for i in range(len(words) - size + 1):
            where[tuple(words[i : i + size])].add((k, i))
    spots = [s for own in where.values() if len({k for k, _ in own}) > 1 for s in own]
    return {(k, i + j) for k, i in spots for j in range(size)}


@pytest.mark.parametrize("stops", [0, 3])
def test_passages_of_short_or_no_sentences_equal_brute_force(spark, tmp_path, stops):
    rng = random.Random(31 + stops)

    def prose(n):
        return [w + (rng.choice("!?.") if stops and k % stops == stops - 1 else "") for k, w in enumerate(sentence(rng, n).split())]

    passages = [prose(n) for n in (49, 50, 51, 51, 60, 80)]
    rows = []
    for k in range(60):
        words = prose(rng.randint(120, 200))
        if k % 2 == 0:
            at = rng.randrange(10, len(words) - 10)
            words[at:at] = passages[k // 2 % 6]
        rows.append((k, " ".join(words), "en", "s", 1))
    docs = stored(spark, frame(spark, rows), tmp_path / "d")
    found = repeated_paragraphs(docs).where("kind = 'passage'").collect()
    want = covered_by_brute_force(rows)
    assert {(r["doc_id"], r["start_word"] + j) for r in found for j in range(r["n_words"])} == want
    assert len({k for k, _ in want}) == 25
    left = {r["doc_id"]: len(r["text"].split()) for r in without_repeats(docs).collect()}
    for k, t, *_ in rows:
        gone = len([1 for d, _ in want if d == k]) if k >= 12 else 0
        assert left[k] == len(t.split()) - gone


def test_text_that_repeats_itself_is_no_passage(spark, tmp_path):
    rng = random.Random(41)
    half = sentence(rng, 60)
    rows = [(k, sentence(rng, 40) + " " + "the " * 90 + "\n" + "a b c " * 30 + sentence(rng, 40), "en", "s", 1) for k in range(12)]
    rows += [(100 + k, f"{sentence(rng, 30)} {half} {sentence(rng, 30)}", "en", "s", 1) for k in range(3)]
    found = repeated_paragraphs(stored(spark, frame(spark, rows), tmp_path / "d")).collect()
    assert {(r["doc_id"], r["kind"], r["n_words"]) for r in found} == {(100 + k, "passage", 60) for k in range(3)}


def test_cutting_spans():
    text = " one two\n\nthree é four\nfive "
    assert without_spans(text, [1 * SPAN_BASE + 2]) == " one é four\nfive "
    assert without_spans(text, [0 * SPAN_BASE + 1, 5 * SPAN_BASE + 1, 4 * SPAN_BASE + 9]) == " two\n\nthree é "
    assert without_spans("", [0]) == "" and without_spans("x", [3 * SPAN_BASE + 1]) == "x"
