"""Filter interaction audit (operator 11): what five document filters remove, alone, together and in every order.

Words are a relation: texts are exploded into words, aggregated by (document, word) and then by document, which
gives totals and distinct words. The flags that need no words are outer-joined to that, and all documents of a
part are aggregated into 32 conditional counts, one for each set of filters that a document fails (and as many
for good and for toxic documents). Whatever an order of the filters keeps, removes or has removed before is a
sum of some of these counts, so no order is ever applied to the documents.

A document is known by its id and the digest of its text; rows that share both are one relation row with a
weight. So no row number has to stay the same between two scans.

Scale: texts are exchanged once, by document, and exploded where their words are then aggregated; rows that share
id and text are salted. Equal texts, however many, meet in partial aggregates first; tables are written before they are joined, so that a
hot text can be split. The orders are 600 fixed rows, unfolded from each part's one row.

Cases: a null text is empty and equal to other empty texts. Rows without an id are counted, but are nobody's copy
and nobody's original; they have no labels. Rows that share an id are documents like any other: the copies of one
id are not copies of a smaller one. A document is good (toxic) if any label row of its id says so; null flags say
nothing. A null language is the part ''. An empty table gives no part and so no row. Texts of any length are read
whole. Extra columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

FILTERS = "ABCDE"
MIN_WORDS = 100
MIN_DISTINCT = 80  # per cent of the words
MAX_CAPITALS = 10  # per cent of the code points
SYMBOLS = "[#$%&*|]"
SPACE = r"\x20\x09-\x0D"
BLANKS = " \t\n\x0b\x0c\r"
SALTS = 64  # parts of the rows that share id and text
SETS = 1 << len(FILTERS)
FACTORIAL = 120


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _digest() -> Column:
    """Half of a SHA-256: it stands beside every word."""
    return F.substring(F.unhex(F.sha2(_text().cast("binary"), 256)), 1, 16)


def word_totals(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, words, distinct_words) of every document. Rows that share id and text are one: a word's
    total is counted from its places, the last place of all being the text's total.

    Texts are exchanged before they are exploded, since their words would take several times as much; then a
    document's words are aggregated where they are. The salt divides rows that share id and text."""
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).alias("salt")
    own = docs.select("doc_id", "text", _digest().alias("digest"), salt).repartition("doc_id", "digest", "salt")
    listed = own.select("doc_id", "digest", "salt", F.split(F.nullif(F.btrim(_text(), F.lit(BLANKS)), F.lit("")), f"[{SPACE}]+").alias("words"))
    words = listed.select("doc_id", "digest", "salt", F.posexplode_outer("words").alias("at", "word"))
    by_word = words.groupBy("doc_id", "digest", "salt", "word").agg(F.max("at").alias("last"))
    by_row = by_word.groupBy("doc_id", "digest", "salt").agg((F.coalesce(F.max("last"), F.lit(-1)) + 1).cast("long").alias("words"), F.count("word").alias("distinct_words"))
    return by_row.groupBy("doc_id", "digest").agg(F.max("words").alias("words"), F.max("distinct_words").alias("distinct_words"))


def text_facts(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, part, capitals, symbols, weight): what can be told without words, for each document, with
    the number of rows that are the same."""
    t = _text()
    capitals = F.regexp_count(t, F.lit("[A-Z]"))
    return docs.select(
        "doc_id", _digest().alias("digest"), F.coalesce("lang", F.lit("")).alias("part"),
        (100 * capitals.cast("long") > MAX_CAPITALS * F.length(t).cast("long")).alias("capitals"), t.rlike(SYMBOLS).alias("symbols"),
    ).groupBy("doc_id", "digest", "part", "capitals", "symbols").agg(F.count("*").alias("weight"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, weight, mask, good, toxic) of every document: bit k of ``mask`` is set if it fails filter k."""
    ws = Workspace(docs.sparkSession, "audit")
    facts = ws.keep(text_facts(docs), "facts")
    totals = ws.keep(word_totals(docs), "totals")
    first = ws.keep(facts.groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("weight").alias("n")).where("n > 1").drop("n"), "first")
    flags = ws.keep(
        labels.where("doc_id is not null").groupBy("doc_id")
        .agg(F.coalesce(F.bool_or(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.bool_or(F.col("toxic") == 1), F.lit(False)).alias("toxic")),
        "flags",
    )
    # An id may be null, so it is compared null-safe.
    f, t = facts.alias("f"), totals.alias("t")
    both = f.join(t, F.col("f.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("f.digest") == F.col("t.digest")), "full_outer")
    rows = both.select("f.*", F.coalesce("t.words", F.lit(0)).alias("words"), F.coalesce("t.distinct_words", F.lit(0)).alias("distinct_words"))
    rows = rows.join(first, "digest", "left").join(flags, "doc_id", "left")
    fails = [
        F.col("words") < MIN_WORDS, 100 * F.col("distinct_words") < MIN_DISTINCT * F.col("words"), F.col("capitals"), F.col("symbols"),
        F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)),
    ]
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(fails)), F.lit(0))
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return rows.select("doc_id", "part", "weight", mask.alias("mask"), no("good"), no("toxic"))


def _counts(where: Column, name: str) -> list[Column]:
    """SETS conditional counts, one for each set of failed filters."""
    return [F.sum(F.when(where & (F.col("mask") == m), F.col("weight")).otherwise(0)).alias(f"{name}{m}") for m in range(SETS)]


def set_counts(rows: DataFrame) -> DataFrame:
    """One row a part, with arrays ``n``, ``good`` and ``toxic`` of SETS counts each."""
    kinds = {"n": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    wide = rows.groupBy("part").agg(*[c for name, where in kinds.items() for c in _counts(where, name)])
    return wide.select("part", *[F.array(*[f"{name}{m}" for m in range(SETS)]).alias(name) for name in kinds])


def _orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, bit, earlier): every step of every order, its filter's bit and those before it."""
    out = []
    for order in permutations(FILTERS):
        earlier = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            out.append(("".join(order), step, bit, earlier))
            earlier |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs(doc_id, text, lang)`` and ``labels(doc_id, quality, toxic)`` to one row for each part, order and
    step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    step = F.from_json(F.lit(str([{"o": o, "s": s, "b": b, "e": e} for o, s, b, e in _orders()]).replace("'", '"')), "array<struct<o:string,s:int,b:int,e:int>>")
    rows = set_counts(failures(docs, labels)).select("*", F.explode(step).alias("x"))
    bit, earlier = F.col("x.b"), F.col("x.e")

    def total(counts: str, where) -> Column:
        """The sum of the counts whose set of failed filters is ``where``."""
        return F.aggregate(
            F.transform(counts, lambda n, m: F.when(where(m), n).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, n: a + n
        )

    fails = lambda m: m.bitwiseAND(bit) != 0
    gone = lambda m: m.bitwiseAND(earlier) != 0
    removed = lambda m: fails(m) & ~gone(m)
    # Of the orders, one in |m| has the filter before all others that a document with failures m fails.
    share = F.transform("n", lambda n, m: F.when(fails(m), n * F.floor(F.lit(FACTORIAL) / F.bit_count(m)).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
        total("n", lambda m: m.bitwiseAND(earlier.bitwiseOR(bit)) == 0).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m) & gone(m)).alias("redundant"), total("n", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        F.aggregate(share, F.lit(0).cast("long"), lambda a, n: a + n).alias("shapley"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, part, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS first FROM d
), marked AS (
  SELECT doc_id, part,
    CASE WHEN len(ws) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask
  FROM w
), l AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), counted AS (
  SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM marked LEFT JOIN l USING (doc_id) GROUP BY part, mask
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || x.c || y.c || z.c AS filter_order
  FROM letters a JOIN letters b ON b.c <> a.c JOIN letters x ON x.c NOT IN (a.c, b.c) JOIN letters y ON y.c NOT IN (a.c, b.c, x.c) JOIN letters z ON z.c NOT IN (a.c, b.c, x.c, y.c)
), steps AS (
  SELECT filter_order, k AS step, 1 << (ascii(substr(filter_order, k, 1)) - 65) AS bit, coalesce(list_sum([1 << (ascii(substr(filter_order, j::INT, 1)) - 65) FOR j IN range(1, k)]), 0)::INT AS earlier
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS k)
), each AS (
  SELECT c.*, filter_order, step, (mask & bit) <> 0 AS fails, (mask & earlier) <> 0 AS gone, mask = bit AS lone FROM counted c, steps
), sums AS (
  SELECT part, filter_order, step, sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN lone THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM each GROUP BY part, filter_order, step
)
SELECT *, (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley FROM sums
"""
