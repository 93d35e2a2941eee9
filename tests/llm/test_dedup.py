import hashlib
import random

import numpy as np
import pytest

from candela.llm import bwt, graph, hashing, minmax_dedup, suffix_dedup


def brute_removed(texts, least=100):
    """(n_removed, n_spans, sha256 of the rest) by a set of all earlier windows."""
    seen, out = set(), []
    for text in texts:
        data = text.encode()
        cover = bytearray(len(data))
        for k in range(len(data) - least + 1):
            window = data[k : k + least]
            if window in seen:
                cover[k : k + least] = b"\1" * least
            seen.add(window)
        rest = bytes(b for b, c in zip(data, cover, strict=True) if not c)
        spans = sum(c and not (k and cover[k - 1]) for k, c in enumerate(cover))
        out.append((len(data) - len(rest), spans, hashlib.sha256(rest).hexdigest()))
    return out


@pytest.mark.parametrize("crowd", [20_000, 1])
def test_repeats_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta"]
    passage = " ".join(rng.choice(words) for _ in range(60))
    texts = []
    for i in range(40):
        own = " ".join(rng.choice(words) + str(rng.randint(0, 500)) for _ in range(rng.randint(5, 120)))
        kind = i % 5
        texts.append(own if kind == 0 else own + passage + own[:50] if kind == 1 else passage[:130] + own if kind == 2 else "ab" * 150 + own if kind == 3 else texts[rng.randrange(i)])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_a_crowded_minimizer_is_split(spark, monkeypatch):
    """Thousands of different surroundings of one string, some of them repeated in part."""
    monkeypatch.setattr(suffix_dedup, "CROWD", 100)
    rng = random.Random(8)
    common = "the same thirty-two byte string!"
    pool = ["".join(rng.choice("abcdefgh") for _ in range(90)) for _ in range(40)]
    texts = ["".join([rng.choice(pool)[-rng.randint(20, 90) :], common, rng.choice(pool)[: rng.randint(20, 90)]]) for _ in range(3000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute_removed(texts)


def test_sides_agree_for_equal_windows():
    rng = random.Random(2)
    for _ in range(50):
        frag = bytes(rng.choice(b"abc") for _ in range(130))
        parts, seen = [(0, 40, 0, 32, 0, frag)], {}
        while parts:
            key, at, left, right, shift, part = parts.pop()
            if right - left == 100:
                seen[shift] = key
                assert len(part) == 100 and part == frag[shift : shift + 100]
            else:
                parts += [(k, a, lo, hi, shift + s, p) for k, a, lo, hi, s, p in suffix_dedup.sides(part, at, left, right)]
        assert sorted(seen) == list(range(31))


def test_repeats_awkward(awkward, empty):
    rows = {(r.doc_id, r.n_bytes): r for r in suffix_dedup.remove_repeats(awkward).collect()}
    assert rows[(1, 0)].n_removed == 0 and rows[(4, 5)].n_removed == 0
    assert rows[(6, 245)].n_removed > 0  # it repeats itself
    assert rows[(7, 245)].n_removed == 245 and rows[(7, 245)].n_spans == 1
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_boundaries_brute_force():
    for seed in range(60):
        rng = random.Random(seed)
        least = rng.choice([2, 3, 5, 8])
        base = "".join(rng.choice("abc") for _ in range(40))
        parts = []
        for _ in range(rng.randint(1, 12)):
            start = rng.randint(0, 30)
            parts.append(base[start : start + rng.randint(least, 20)])
        text = np.frombuffer(("\0".join(parts) + "\0").encode(), np.uint8)
        raw, order = text.tobytes(), bwt.suffix_order(text, max(16, least))
        marked = bwt.boundaries(text, order, least)
        for k in range(1, len(order)):
            a, b = raw[order[k - 1] :][:least], raw[order[k] :][:least]
            if len(a) == len(b) == least and b"\0" not in a + b:
                assert marked[k] == (a != b)


def components_of(sets, link=85):
    ids = sorted(sets)
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= link * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def shingle_set(text, width=5):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return set()
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def test_near_duplicates_match_brute_force(spark, sample):
    docs = spark.read.parquet(f"{sample}/documents.parquet")
    want = {r.doc_id: shingle_set(r.text) for r in docs.collect()}
    roots = components_of(want)
    for r in minmax_dedup.near_duplicates(docs).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(want[r.doc_id]), roots[r.doc_id], roots[r.doc_id] == r.doc_id)


def test_chain_beyond_leaders(spark, monkeypatch):
    """A chain of documents whose ends are no duplicates is one component, blocks or not."""
    monkeypatch.setattr(minmax_dedup, "BLOCK", 3)
    monkeypatch.setattr(minmax_dedup, "LEAST_HOT", 2)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words[7 * i : 7 * i + 200]) for i in range(12)]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = components_of({i + 1: shingle_set(t) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(docs).collect()} == want


def joined(labels, pairs):
    """The label that each label ends at when ``pairs`` are joined."""
    root = {x: x for x in labels}
    for a, b in pairs:
        a, b = root[a], root[b]
        root = {x: min(a, b) if r in (a, b) else r for x, r in root.items()}
    return root


@pytest.mark.parametrize("labels", [[7, 3, 5], [9, 3, 5, 3, 9], [4, 4, 2, 2, 6, 6, 1], [5, 5, 5], [8, 1, 1, 1, 8, 2], list(range(12, 0, -1))])
@pytest.mark.parametrize("sided", [False, True])
def test_block_links_match_brute_force(labels, sided):
    for seed in range(40):
        rng = np.random.default_rng(seed)
        bases = [rng.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(2)]
        sets = [np.unique(np.concatenate([bases[rng.integers(2)][rng.integers(0, 5) :], rng.integers(0, 2**63, rng.integers(0, 3), dtype=np.uint64)])) for _ in labels]
        sides = rng.integers(0, 2, len(labels)).tolist() if sided else [0] * len(labels)
        across = len(set(sides)) > 1
        pairs = [(i, j) for i in range(len(labels)) for j in range(i) if labels[i] != labels[j] and not (across and sides[i] == sides[j])]
        want = [(labels[i], labels[j]) for i, j in pairs if minmax_dedup.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
        got = minmax_dedup.block_links(labels, sides, sets)
        assert joined(labels, got) == joined(labels, want) and len(got) < len(set(labels))


def test_crowded_buckets_of_templates(spark, monkeypatch):
    """Many texts of one template share bands, and only some of them enough of their words."""
    monkeypatch.setattr(minmax_dedup, "BLOCK", 7)
    monkeypatch.setattr(minmax_dedup, "LEAST_HOT", 5)
    rng = np.random.default_rng(3)
    frame = [f"t{i}" for i in range(120)]
    texts = [" ".join([*frame, *[f"v{rng.integers(6)}x{k}" for k in range(int(rng.integers(4, 40)))]]) for _ in range(60)]
    docs = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "doc_id long, text string")
    want = components_of({i + 1: shingle_set(t) for i, t in enumerate(texts)})
    assert {r.doc_id: r.component_id for r in minmax_dedup.near_duplicates(docs).collect()} == want and 1 < len(set(want.values())) < 60


def test_near_duplicates_awkward(awkward, empty):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax_dedup.near_duplicates(awkward).collect()]
    assert (1, 0, 1, True) in rows and (2, 0, 2, True) in rows and (4, 1, 4, True) in rows
    assert rows.count((7, 10, 6, False)) == 2
    assert minmax_dedup.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in minmax_dedup.drop_near_duplicates(awkward).collect()]
    assert sorted(str(x) for x in kept) == sorted(["1", "2", "3", "4", "5", "6", "8", "9", "None"])


def test_components(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(1, 40)] + [(100, 101), (7, 7)], "u long, v long")
    labels = {r.node: r.label for r in graph.components(edges).collect()}
    assert set(labels) == {*range(1, 41), 100, 101} and all(labels[i] == 1 for i in range(1, 41)) and labels[101] == 100


def test_min_and_max_estimate_likeness():
    a, b = np.arange(1, 1001, dtype=np.uint64), np.arange(101, 1101, dtype=np.uint64)
    with np.errstate(over="ignore"):
        a, b = hashing.mix(a), hashing.mix(b)
    agree = (minmax_dedup.signature(a) == minmax_dedup.signature(b)).mean()
    assert abs(agree - 900 / 1100) < 0.15
