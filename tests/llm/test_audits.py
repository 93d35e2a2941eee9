"""Archive, filter audit and source divergence against brute force."""

import base64
import gzip
import hashlib
import random
from collections import Counter, defaultdict
from itertools import permutations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from candela.llm import divergence, filter_audit, warc
from candela.llm.trie import RadixTrie, SourceTrie

PAGES = [
    (1, "http://a/1", "<p>one</p>", "x"), (2, "http://a/2", "<p>two</p>", "x"), (3, "http://a/3", "<p>one</p>", "x"), (4, None, None, "x"), (5, "http://a/5", "", "x"),
    (5, "http://a/5", "", "x"), (6, "http://a/6", "line\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc", "x"), (None, "http://a/7", "<p>one</p>", "x"),
    (8, "http://ä/ü?x=\r\n1", "größe " * 30_000, "x"), (9, "http://a/9", "größe " * 30_000, "x"),
]
PAGE_SCHEMA = "page_id long, url string, html string, digest string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, PAGE_SCHEMA)


def parsed(record):
    """A record's fields and block, read by splitting its bytes."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    assert version == "WARC/1.1" and len(rest) == int(fields["Content-Length"]) + 4 and rest.endswith(b"\r\n\r\n")
    return fields, rest[:-4]


def test_archive_stores_payloads_once_and_gives_records_back(pages):
    heads, payloads = warc.archive(pages)
    assert payloads.count() == len({p[2] or "" for p in PAGES})
    rows = warc.restore(heads, payloads).collect()
    assert len(rows) == len(PAGES)
    want = defaultdict(list)
    for p in PAGES:
        want[p[2] or ""].append((p[0] is None, p[0] or 0))
    ids = {}
    for r in rows:
        fields, block = parsed(bytes(r.record))
        payload = bytes(r.payload)
        ids[fields["WARC-Record-ID"]] = r
        assert hashlib.sha256(payload).hexdigest() == r.digest
        assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert block == (payload if fields["WARC-Type"] == "response" else b"")
        assert (fields.get("WARC-Source-Page") or None) == (None if r.page_id is None else str(r.page_id))
    assert len(ids) == len(rows)
    types = Counter((bytes(r.payload), parsed(bytes(r.record))[0]["WARC-Type"]) for r in rows)
    for text, ids_ in want.items():
        assert types[text.encode(), "response"] == 1 and types[text.encode(), "revisit"] == len(ids_) - 1
    for r in rows:
        fields, _ = parsed(bytes(r.record))
        if fields["WARC-Type"] == "revisit":
            assert bytes(ids[fields["WARC-Refers-To"]].payload) == bytes(r.payload)


def test_archived_pages_says_what_was_read(spark, pages, empty):
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archived_pages(pages).collect())
    first = {}
    for p in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        first.setdefault(p[2] or "", p[0])
    seen, want = set(), Counter()
    for p in sorted(PAGES, key=lambda p: (p[0] is None, p[0])):
        data = (p[2] or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        new = data not in seen
        seen.add(data)
        want[(p[0], len(data), digest, "response" if new else "revisit", None if new else first[p[2] or ""])] += 1
    assert got == want
    small = warc.archived_pages(pages, min_bytes=11)
    assert {r.record_type for r in small.where("payload_bytes < 11").collect()} == {"response"}
    assert small.where("record_type = 'revisit'").count() == 1
    none = empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"), F.col("text").alias("html"))
    assert warc.archived_pages(none).count() == 0


def test_archive_notices_damage(spark, pages):
    heads, payloads = warc.archive(pages)
    wrong = payloads.withColumn("stored", F.lit(warc.pack(b"another")))
    with pytest.raises(Exception, match="does not match its address"):
        warc.restore(heads, wrong).collect()
    with pytest.raises(Exception, match="no payload at address"):
        warc.restore(heads, payloads.limit(1)).collect()
    records = warc.restore(heads, payloads).withColumn("record", F.concat("record", F.lit(b"!")))
    with pytest.raises(Exception, match="length is wrong"):
        warc.read_records(records.drop("payload")).collect()


def test_files_are_records_one_after_another(spark, pages, tmp_path):
    records = warc.restore(*warc.archive(pages))
    warc.write_files(records, str(tmp_path / "out"), files=2)
    text = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path / "out").glob("*.gz")))
    want = sorted(bytes(r.record) for r in records.collect())
    assert len(text) == sum(map(len, want)) and all(text.count(r) for r in want)
    back = warc.read_files(spark, str(tmp_path / "out"))
    assert sorted(bytes(r.record) for r in back.collect()) == want
    assert sorted(r.record_type for r in warc.read_records(back).collect()) == sorted(parsed(r)[0]["WARC-Type"] for r in want)


LABELS = [(1, 1, 1), (4, 1, 0), (6, 0, 1), (7, 1, 1), (7, 0, 0), (8, 0, 0), (None, 1, 1), (99, 1, 1)]


def filters_by_hand(docs, labels):
    """Each document through each order, one at a time."""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in (0, 1))
    first = {}
    for d, text, _ in docs:
        if d is not None:
            first[text or ""] = min(first.get(text or "", d), d)
    told = []
    for d, text, lang in docs:
        text = text or ""
        words = [w for w in text.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
        failed = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text),
            "D": bool(set(text) & set("#$%&*|")), "E": d is not None and d > first[text]}
        told.append((lang or "", {f for f, x in failed.items() if x}, d in good, d in toxic))
    rows = {}
    for part in {t[0] for t in told}:
        mine, total = [t for t in told if t[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = mine
            for k, f in enumerate(order):
                gone, stay = [t for t in left if f in t[1]], [t for t in left if f not in t[1]]
                earlier = sum(f in t[1] for t in mine) - len(gone)
                rows[part, "".join(order), k + 1] = [len(stay), len(gone), earlier, sum(t[1] == {f} for t in mine), sum(t[2] for t in gone), sum(t[3] for t in gone), f]
                total[f] += len(gone)
                left = stay
        for (p, *_), row in rows.items():
            if p == part:
                row.append(total[row[6]])
    return rows


def test_filter_audit_by_hand(spark, awkward, empty):
    rng = random.Random(3)
    extra = []
    for i in range(100, 160):
        words = [rng.choice(["Aa", "bb", "cc#", "DD", "e", "f\x0bg"]) + (str(rng.randrange(400)) if i % 2 else "") for _ in range(rng.choice([20, 150]))]
        extra.append((i, " ".join(words), rng.choice(["en", "de", None, ""]), "s", 0, "x"))
    extra += [(200 + i, rng.choice(extra)[1], rng.choice(["en", "fr"]), "s", 0, "x") for i in range(40)]
    docs = awkward.unionByName(spark.createDataFrame(extra, awkward.schema))
    labels = spark.createDataFrame(LABELS + [(i, i % 2, int(i % 4 == 0)) for i in range(100, 240, 3)], "doc_id long, quality int, toxic int")
    want = filters_by_hand([(r.doc_id, r.text, r.lang) for r in docs.collect()], [tuple(r) for r in labels.collect()])
    got = {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "filter", "shapley")]
        for r in filter_audit.audit(docs, labels).collect()}
    assert got == want
    assert filter_audit.audit(empty, labels).count() == 0
    assert len(filter_audit.audit(awkward, labels.limit(0)).collect()) == 600 * len({r.lang or "" for r in awkward.collect()})


def test_survivors_have_every_subset(spark, awkward):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    rows = filter_audit.survivors(filter_audit.patterns(awkward, labels)).collect()
    assert Counter(r.part for r in rows) == {r.lang or "": 32 for r in awkward.collect()}


def test_trie_counts_merges_and_walks():
    rng = random.Random(5)
    words = ["".join(rng.choice("abéü€") for _ in range(rng.randrange(0, 7))).encode() for _ in range(3000)] + [b"a" * n for n in range(3000)]
    tries, want = (SourceTrie(), SourceTrie()), defaultdict(Counter)
    for k in range(6):
        mine = Counter(words[k::6])
        tries[k % 2].add(f"s{k % 3}", mine, {w: 2 * n for w, n in mine.items()})
        for w, n in mine.items():
            want[w][f"s{k % 3}"] += n
    one, two = tries
    one.merge(two)
    assert one.trie.size == len(want)
    terms, sources, term, source, n, docs = one.leaves()
    assert terms == sorted(want) and sources == ["s0", "s1", "s2"]
    assert [(terms[t], sources[s], k) for t, s, k in zip(term, source, n, strict=True)] == [(w, s, want[w][s]) for w in sorted(want) for s in sorted(want[w])]
    assert (docs == 2 * n).all()
    for lo, hi in ((b"a", b"b"), (b"", "é".encode()), ("ü".encode(), None), (b"aab", b"aab\xff")):
        assert [w for w, _ in one.trie.walk(lo, hi)] == [w for w in sorted(want) if w >= lo and (hi is None or w < hi)]
    assert [w for w, _ in RadixTrie().walk()] == []


def test_shares_are_exact():
    rng = random.Random(7)
    for _ in range(300):
        kept = rng.randrange(1, 10**6)
        total = rng.randrange(0, 9 * 10**15)
        count = rng.randrange(0, total + 1)
        assert int(divergence.share(np.array([count]), total, kept)[0]) == 1 + 10**9 * (count + 2) // (total + 2 * kept)
    assert int(divergence.share(np.array([7]), 7, 1)[0]) == 1 + 10**9


def test_trie_filled_in_order_is_the_one_made_leaf_by_leaf(monkeypatch):
    rng = random.Random(13)
    words = sorted({bytes(rng.choices((97, 98, 0xC3, 0xA9), k=rng.randint(0, 9))) for _ in range(600)} | {b"", b"a" * 3000, b"a" * 3000 + b"b"})
    filled, single = RadixTrie(), RadixTrie()
    filled.fill(words)
    for w in words:
        single.leaf(w)
    assert list(filled.walk()) == list(single.walk()) == [(w, i) for i, w in enumerate(words)]
    assert list(filled.walk(b"ab", b"b")) == [(w, i) for i, w in enumerate(words) if b"ab" <= w < b"b"]
    for w in rng.sample(words, 50):
        assert filled.leaf(w) == words.index(w)
    assert divergence.terms("Ab\x00c\x85é_Éx\u00a0y\x7f\x0bz'".encode()) == [b"ab", "c\x85é".encode(), "Éx\u00a0y".encode(), b"z"]
    # terms are not looked for from the root, which made counting exceed its seconds
    monkeypatch.setattr(RadixTrie, "leaf", None)
    trie = SourceTrie()
    trie.add("s", dict.fromkeys(words, 2), dict.fromkeys(words, 1))
    assert trie.leaves()[0] == words


def divergence_by_hand(docs):
    terms = {}
    for i, (text, lang, source) in enumerate(docs):
        found = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text or "").split(" ")
        terms[i] = (lang or "", source or "", Counter(x for x in found if x))
    rows = []
    for lang in {t[0] for t in terms.values()}:
        mine = [t for t in terms.values() if t[0] == lang]
        df, total = Counter(), Counter()
        for t in mine:
            df.update(t[2].keys())
            total.update(t[2])
        kept = [w for w in df if df[w] >= 10]
        counts = defaultdict(Counter)
        for t in mine:
            counts[t[1]].update({w: n for w, n in t[2].items() if df[w] >= 10})
        share = lambda c, n: 1 + 10**9 * (c + 2) // (n + 2 * len(kept))
        whole = sum(total[w] for w in kept)
        p = {s: {w: share(counts[s][w], sum(counts[s].values())) for w in kept} for s in {t[1] for t in mine}}
        q = {w: share(total[w], whole) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in p:
            pairs = sorted((-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in p if o != s)
            best = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])[:10]
            rows += [(lang, s, part, item.decode(), -v, i + 1) for part, found in (("pair", pairs), ("term", best)) for i, (v, item) in enumerate(found)]
    return sorted(rows)


def test_divergence_by_hand(spark, awkward, empty, monkeypatch):
    rng = random.Random(11)
    vocabulary = ["Alpha", "beta", "GAMMA", "über", "naïve", "x", "日本", "é", "don't", "a1b"] + [f"w{chr(97 + i)}" for i in range(20)]
    docs = []
    for i in range(200):
        words = [rng.choice(vocabulary[: rng.randrange(5, 30)]) for _ in range(rng.randrange(0, 40))]
        docs.append((i, " ".join(words), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "e", "", None]), 0, "x"))
    docs.append((900, "only here", "tiny", "a", 0, "x"))
    docs.append((901, None, "tiny", "b", 0, "x"))
    table = awkward.unionByName(spark.createDataFrame(docs, awkward.schema)).repartition(5)
    want = divergence_by_hand([(r.text, r.lang, r.source) for r in table.collect()])

    def got():
        return sorted(tuple(r) for r in divergence.audit_sources(table).collect())

    assert got() == want
    monkeypatch.setattr(divergence, "BLOCK", 2)  # several blocks of sources
    assert got() == want
    assert divergence.audit_sources(empty).count() == 0


def test_partial_tries_and_ranges_add_up(monkeypatch):
    """Tries sent on early, batches that cut terms apart, and many small ranges give the same leaves."""
    rng = random.Random(13)
    rows = pa.table({"lang": ["l"] * 60, "source": [f"s{i % 4}" for i in range(60)], "text": [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(50))
        for _ in range(60)]})
    monkeypatch.setattr(divergence.TaskContext, "get", staticmethod(lambda: type("Task", (), {"partitionId": lambda self: 0})()))

    def merged(held, entries, size):
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "SENT", size)
        monkeypatch.setattr(divergence, "RANGE_ENTRIES", entries)
        leaves = pa.Table.from_batches(list(divergence._count(iter(rows.to_batches(max_chunksize=20))))).sort_by([(c, "ascending") for c in ("lang", "term", "source")])
        out = pa.Table.from_batches(list(divergence._merge(iter(leaves.combine_chunks().to_batches(max_chunksize=size))))).to_pandas()
        return out, {(r.term, r.source): (r.n, r.first) for r in out.itertuples()}

    one, whole = merged(10**6, 10**6, 10**6)
    many, parts = merged(5, 7, 3)
    assert whole == parts and len(parts) == len(many) and one["range_no"].nunique() == 1
    assert many["range_no"].is_monotonic_increasing and many.groupby("range_no").size().max() <= 7 + 4
