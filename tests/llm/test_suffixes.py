import hashlib
import random

import numpy as np
import pyarrow as pa

from folioscope.llm import suffixes
from tests.llm.conftest import frame


def brute(docs, length=100):
    seen, out = {}, {}
    for i, t, *_ in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            else:
                seen[w] = True
        kept = bytes(x for x, y in zip(b, gone, strict=True) if not y)
        out[i] = (len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(kept).hexdigest())
    return out


def run(spark, docs):
    got = suffixes.remove_repeats(frame(spark, docs)).collect()
    for r in got:
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed
    return got


def test_equals_a_search_of_all_windows(spark, corpus):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, corpus)}
    want = brute(corpus)
    assert got == want and sum(x[1] for x in want.values()) > 10_000


def test_periods_borders_and_hot_contexts(spark):
    r = random.Random(4)
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    line, docs = word(70), []
    for k in range(150):
        docs.append((k, word(r.randrange(60)) + line + word(r.randrange(90)) + line, "en", "s", 0))
    docs += [(200, "a" * 99, "", "", 0), (201, "a" * 99, "", "", 0), (202, "a" * 100, "", "", 0), (203, "a" * 101, "", "", 0), (204, "xyz" * 500, "", "", 0), (205, "x" + "xyz" * 40, "", "", 0)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in run(spark, docs)}
    assert got == brute(docs)


def test_empty_nameless_and_repeated_rows(spark):
    assert run(spark, []) == []
    r = random.Random(3)
    t = "".join(r.choice("abcdefgh") for _ in range(150))
    got = sorted((str(x.doc_id), x.n_bytes, x.n_removed) for x in run(spark, [(None, t, "", "", 0), (3, t, "", "", 0), (3, t, "", "", 0), (5, t, "", "", 0), (6, None, None, None, None)]))
    assert got == [("3", 150, 0), ("3", 150, 0), ("5", 150, 150), ("6", 0, 0), ("None", 150, 0)]


def test_long_texts_are_cut_without_losing_windows(spark):
    r = random.Random(9)
    passage = "".join(r.choice("abcdefghijklmnop ") for _ in range(150))
    body = "".join(r.choice("abcdefghijklmnop ") for _ in range(suffixes.BUFFER - 80))
    docs = [(1, passage, "", "", 0), (2, body + passage + body[:50], "", "", 0)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans) for x in run(spark, docs)}
    assert got == {1: (150, 0, 0), 2: (len(docs[1][1]), 150, 1)}


def test_negative_ids_are_ids(spark):
    r = random.Random(5)
    passage, other = ("".join(r.choice("abcdefgh ") for _ in range(150)) for _ in range(2))
    docs = [(-7, passage + "x" + other, "", "", 0), (-1, "y" + passage, "", "", 0), (0, other + "z", "", "", 0), (4, passage + "w" * 20 + other, "", "", 0), (-(1 << 63), "v" * 120 + other, "", "", 0)]
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in run(spark, docs)}
    assert got == brute(docs) and got[-1][1] == 150


def test_windows_are_ordered_by_their_bytes():
    r = random.Random(21)
    for length in (32, 40, 100, 101):
        parts = ["".join(r.choice("ab") for _ in range(n)) for n in (3, 60, 20, 60)]
        text = "".join(r.choice(parts) for _ in range(200)).encode()
        place = np.arange(len(text) - length + 1)
        group = np.array([r.randrange(2) for _ in place])
        rows, new = suffixes.byte_groups(np.frombuffer(text, np.uint8), place, group, length)
        want = {}
        for p in place.tolist():
            want.setdefault((group[p], text[p : p + length]), []).append(p)
        got = [g.tolist() for g in np.split(rows, np.flatnonzero(new)[1:]) if len(g)]
        assert sorted(got) == sorted(g for g in want.values() if len(g) > 1) and len(got)


def test_minimizers_that_collide_change_nothing():
    """All items under one key, as if every minimizer had the same fingerprint."""
    r = random.Random(22)
    shared = [bytes(r.choices(b"abcd", k=140)) for _ in range(6)]
    rows = []
    for doc in range(120):
        body = bytes(r.choices(b"abcd", k=r.randrange(40))) + r.choice(shared) + bytes(r.choices(b"abcd", k=r.randrange(40)))
        rows.append((doc, r.randrange(5) * 200, body))
    r.shuffle(rows)
    doc, start, bodies = (list(c) for c in zip(*rows, strict=True))
    n = np.array([len(b) - 99 for b in bodies])
    seen, want = set(), set()
    for d, s, b in sorted(rows):
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                want.add((d, s + k))
            seen.add(b[k : k + 100])
    for key in (np.zeros(len(rows), np.int64), np.full(len(rows), -7)):
        got = suffixes._repeats_in(key, np.array(doc), np.array(start), n, pa.array(bodies, pa.binary()), 100)
        assert {(d, s + k) for d, s, m in zip(*(c.tolist() for c in got), strict=True) for k in range(m)} == want and want
