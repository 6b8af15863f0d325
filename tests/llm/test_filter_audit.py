"""Filter interaction audit (operator 11) against the SQL, and against filters that are really applied in every order."""

from __future__ import annotations

import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from folioscope.llm import filter_audit
from pyspark.sql import functions as F

from tests.llm.conftest import DATA, frame

COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
LABELS = "doc_id long, quality int, toxic int"


def applied(docs, labels):
    """The contract's figures by applying the filters one after the other."""
    good, toxic = ({d for d, *x in labels if d is not None and x[k] == 1} for k in range(2))
    least = {}
    for doc, text, *_ in docs:
        if doc is not None:
            least[text or ""] = min(least.get(text or "", doc), doc)
    rows = []
    for doc, text, lang, *_ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = "".join(c for c, x in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)),
            doc is not None and t in least and least[t] < doc,
        ), strict=True) if x)
        rows.append((doc, lang or "", failed))
    out, shapley = {}, Counter()
    for part in {p for _, p, _ in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[1] == part]
            before = []
            for step, c in enumerate(order, 1):
                gone = [r for r in left if c in r[2]]
                left = [r for r in left if c not in r[2]]
                own = [r for r in rows if r[1] == part]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(c in r[2] for r in before), sum(r[2] == c for r in own), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)
                ]
                shapley[part, c] += len(gone)
                before += gone
    return sorted((p, o, s, *x, shapley[p, o[s - 1]]) for (p, o, s), x in out.items())


def found(docs, labels):
    return sorted(tuple(r) for r in filter_audit.audit(docs, labels).select(*COLUMNS).collect())


def awkward():
    r = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    docs = []
    for k in range(120):
        body = r.sample(words, 120) if k % 3 else r.choices(words[:60], k=150)
        text = " ".join(body[: 40 if k % 5 == 0 else 150])
        text = text.upper() if k % 7 == 0 else text
        docs.append((k, text + (" a#b" if k % 4 == 0 else ""), ("en", "de", None, "")[k % 4], "s", 1))
    docs += [(200 + k, docs[k][1], "en", "s", 1) for k in range(0, 60, 2)]  # copies
    docs += [docs[7], docs[7], docs[31], (7, "another text of the same id", "en", "s", 1)]  # repeated rows, a repeated id
    docs += [(300, None, "en", "s", 1), (301, "", None, "s", 1), (302, None, "fr", "s", 1), (None, docs[3][1], "en", "s", 1), (None, None, None, None, None)]
    docs += [(303, "x" * 1_000_000, "en", "s", 1), (304, "One Two\x0b\tThree Four " * 50_000, "en", "s", 1), (-5, "É" * 9 + "A", "de", "s", 1), (-6, "É" * 8 + "A", "de", "s", 1)]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 260, 3)] + [(3, 0, None), (3, None, 1), (None, 1, 1), (9999, 1, 1)]
    return docs, labels


def test_equals_filters_applied_in_every_order(spark):
    docs, labels = awkward()
    clashing = ("digest", "mask", "weight", "first", "words", "good", "n", "word", "part", "capitals")
    own = frame(spark, docs).withColumns({c: F.lit("x") for c in clashing})
    marks = frame(spark, labels, LABELS).withColumns({c: F.lit("x") for c in ("good", "text", "lang", "first")})
    assert found(own, marks) == applied(docs, labels)


def test_empty_tables(spark):
    docs, labels = awkward()
    assert found(frame(spark, [], extra=False), frame(spark, labels, LABELS)) == []
    assert found(frame(spark, docs[:30]), frame(spark, [], LABELS)) == applied(docs[:30], [])


def test_one_text_in_a_third_of_all_rows(spark):
    docs = [(k, "the same words in all of them " * 30 if k % 3 == 0 else f"word{k} " * (k % 200), "en", "s", 1) for k in range(3000)]
    assert found(frame(spark, docs), frame(spark, [(k, 1, 0) for k in range(0, 3000, 2)], LABELS)) == applied(docs, [(k, 1, 0) for k in range(0, 3000, 2)])


@pytest.mark.skipif(not DATA.exists(), reason="no tables")
def test_equals_sql(spark):
    for name in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM read_parquet('{DATA}/{name}.parquet')")
    want = sorted(duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({filter_audit.SQL})").fetchall())
    got = found(*(spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels")))
    assert got == want and len(got) % 600 == 0 and got
