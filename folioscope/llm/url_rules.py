"""URL filters by association rules (operator 12).

A list of given rules judges the urls that it covers. These urls, with their verdicts, are the labels from which
FP-growth mines combinations of url tokens: a combination is a rule for a verdict if it has the support and
the confidence asked for and no part of it is as sure of the same verdict by itself. Urls that no given rule covers
get the verdict of the surest mined rule whose tokens they all hold; without one they are allowed: nothing speaks against them.

Mined rules are matched by an inverted index: a rule is listed under the rarest of its tokens, a url meets the
lists of its own tokens, and of these rules those stay whose other tokens it has too. Urls with the same known
tokens are judged once.

Tokens are the scheme, host names and their suffix, words of the path and names of the query, each with what it is.
Numbers count as one token. All tokens that have the support are known, and all known tokens of a url are mined: no
combination is left out. The support bounds their number by the mean tokens of a label over the support.

Patterns grow item by item, each in the rows that hold it (its projected database), all patterns of a length at a time.
Spark's FPGrowth lists every frequent combination, 2 ** n for a frequent url of n tokens, of which nearly all are no rules.
So a pattern grows on only if it can be part of a rule: if a part has the same number of labels, that part is as sure; if all
its labels have one verdict, it is as sure as any longer one. Neither can become part of a rule again, so the rules are those of all combinations.

Scale: tokens, labels and urls' known tokens are counted with partial aggregates, so a host with a third of all rows is
one row for each task. Labels with the same tokens are one row, with counts, and each holds the patterns that occur in it.
Only the vocabulary and one row of totals are collected.

Cases: a null url, or one without "://", has empty host and path; it has no tokens, fits no rule and is allowed, as
is every url that no given rule covers if there are no labels. Repeated rows are labels and urls as often as they
occur. Labels without a verdict of the two, or without tokens, teach nothing. Ties between mined rules go to more support,
then to more tokens, then to the one that sorts first. An empty table gives an empty result. Long urls are read whole. Extra
columns are kept by ``judge`` and ignored by the query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

ALLOW, BLOCK = "allow", "block"
RULES = (  # (verdict, host, path)
    (ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/"),
)
SUPPORT = 0.005  # of the labels
CONFIDENCE = 0.9
VOCABULARY = ITEMS = None  # known tokens, and those mined of a url: no bound
MINED = "tokens array<string>, verdict string, confidence double, support double"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first "://", null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def given(rules: tuple = RULES) -> Column:
    """A struct (rule, verdict) of the longest of ``rules(verdict, host, path)`` that fits the columns ``host`` and
    ``path``, null without one. A short list, hence one expression."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # the longest is asked first
        own = (F.col("host") == h) | F.endswith("host", F.lit("." + h))
        out = F.when(own & F.startswith("path", F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens(url: Column) -> Column:
    """The distinct tokens of a url with columns ``host`` and ``path``; none without a host."""
    named = lambda kind, items: F.transform(F.filter(items, lambda t: t != ""), lambda t: F.concat(F.lit(f"{kind}:"), t))
    numbered = lambda c: F.regexp_replace(c, "[0-9]+", "0")
    names = F.split(numbered(F.col("host")), r"\.")
    words = F.split(numbered(F.lower("path")), r"[^\p{L}\p{N}]+")
    query = F.regexp_extract(_rest(url), r"\?([^#]*)", 1)
    keys = F.transform(F.split(query, "&"), lambda x: numbered(F.lower(F.substring_index(x, "=", 1))))
    scheme = F.lower(F.substring_index(url, "://", 1))
    found = F.concat(
        named("scheme", F.array(scheme)), named("host", names), named("suffix", F.slice(names, -1, 1)), named("path", words), named("query", keys)
    )
    return F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.array_distinct(found))


def parsed(urls: DataFrame) -> DataFrame:
    return urls.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})


def vocabulary(labelled: DataFrame, support: float = SUPPORT) -> dict[str, int]:
    """Tokens of at least ``support`` of ``labelled(tokens, verdict)``, those that tell most about the verdict
    first. Each with the number of labels that have it."""
    totals = labelled.agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == BLOCK).alias("blocked")).first()
    n, blocked = totals.n, totals.blocked
    if not n:
        return {}
    with_token = labelled.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == BLOCK).alias("blocked"))
    entropy = lambda part, whole: F.when((part > 0) & (part < whole), -(part / whole) * F.log2(part / whole) - (1 - part / whole) * F.log2(1 - part / whole)).otherwise(0.0)
    have, rest = F.col("n"), F.lit(n) - F.col("n")
    left = (have * entropy(F.col("blocked"), have) + F.when(rest > 0, rest * entropy(F.lit(blocked) - F.col("blocked"), rest)).otherwise(0.0)) / n
    best = with_token.where(F.col("n") >= math.ceil(support * n)).select("token", F.round(left, 9).alias("left"), "n")
    return {r.token: r.n for r in best.orderBy("left", F.desc("n"), "token").collect()}  # at most the mean tokens of a label over ``support``


def _known(words: dict[str, int]) -> Column:
    """The known tokens of a row, in the order of the vocabulary."""
    return F.array_intersect(F.array(*[F.lit(w) for w in words]).cast("array<string>"), "tokens") if words else F.array().cast("array<string>")


def mine(labelled: DataFrame, words: dict[str, int], support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """MINED rules from ``labelled(tokens, verdict)``: every combination of ``words`` that is frequent together with a
    verdict and points to it with the confidence asked for, unless a part of it does as surely.

    ``grown`` has a row for each pattern and each set of tokens that holds it, with the tokens behind the pattern's last
    one in the order of names. A pattern's labels are counted from its rows; what is frequent but has not the same labels
    as one of its parts is kept, and grows by each of these tokens if its labels differ in verdict."""
    spark = labelled.sparkSession
    if not words:
        return spark.createDataFrame([], MINED)
    ws = Workspace(spark, "url-rules")
    blocked = F.count_if(F.col("verdict") == BLOCK)
    sets = ws.keep(labelled.select(F.array_sort(_known(words)).alias("items"), "verdict").groupBy("items").agg(F.count("*").alias("n"), blocked.alias("bad")), "sets")
    total = sets.agg(F.sum("n")).first()[0]
    least = math.ceil(support * total)
    rest = lambda at: F.slice("items", at + 1, F.size("items"))
    step = lambda rows, tokens: rows.select("n", "bad", F.explode(F.transform("items", lambda t, i: F.struct(tokens(t).alias("tokens"), rest(i + 1).alias("items")))).alias("x")).select("n", "bad", "x.tokens", "x.items")
    grown, rules, known, size = step(sets, lambda t: F.array(t)), None, None, 1
    while True:
        counts = grown.groupBy("tokens").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where((F.col("bad") >= least) | (F.col("n") - F.col("bad") >= least))
        if size > 1:  # each part without one token must be known, and have more labels
            parts = counts.select("tokens", "n", F.explode(F.transform("tokens", lambda _, i: F.filter("tokens", lambda _, k: k != i))).alias("part"))
            whole = parts.join(known.select(F.col("tokens").alias("part"), F.col("n").alias("more")), "part").where(F.col("more") > F.col("n"))
            counts = counts.join(whole.groupBy("tokens").count().where(F.col("count") == size).select("tokens"), "tokens", "left_semi")
        counts = ws.keep(counts, f"patterns{size}")
        if counts.isEmpty():
            break
        n, bad = F.col("n"), F.col("bad")
        each = F.explode(F.array(F.struct(F.lit(BLOCK).alias("verdict"), bad.alias("own")), F.struct(F.lit(ALLOW).alias("verdict"), (n - bad).alias("own"))))
        sure = counts.select("tokens", "n", each.alias("x")).where((F.col("x.own") >= least) & (F.col("x.own") / n >= confidence))
        sure = sure.select("tokens", "x.verdict", F.round(F.col("x.own") / n, 9).alias("confidence"), F.round(F.col("x.own") / total, 9).alias("support"))
        rules = sure if rules is None else rules.unionByName(sure)
        known = counts.where((bad > 0) & (bad < n) & (n < total))  # others are parts of no longer rule
        if size == 1:  # from here on sets are of tokens that can be parts
            able = F.array(*[F.lit(r.tokens[0]) for r in known.select("tokens").collect()]).cast("array<string>")  # at most ``words``
            sets = ws.keep(sets.withColumn("items", F.array_intersect("items", able)).groupBy("items").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "able")
            grown = step(sets, lambda t: F.array(t))
        held = grown.join(known.select("tokens"), "tokens", "left_semi").withColumnRenamed("tokens", "held").where("size(items) > 0")
        grown = held.select("n", "bad", "held", F.explode(F.transform("items", lambda t, i: F.struct(t.alias("t"), rest(i + 1).alias("items")))).alias("x"))
        grown = ws.keep(grown.select("n", "bad", F.concat("held", F.array("x.t")).alias("tokens"), F.col("x.items").alias("items")), f"grown{size}")
        size += 1
    return spark.createDataFrame([], MINED) if rules is None else _general(ws.keep(rules, "mined"))


def _general(rules: DataFrame) -> DataFrame:
    """``rules`` without those of which a part is a rule for the same verdict that is at least as sure. A rule meets those
    whose first token it has; it does not list its parts."""
    parts = rules.where(F.size("tokens") > 1).select("tokens", "verdict", "confidence", F.explode("tokens").alias("t"))
    surer = rules.select(F.col("tokens").alias("part"), F.get("tokens", F.lit(0)).alias("t"), "verdict", F.col("confidence").alias("own"))
    beaten = parts.join(surer, ["t", "verdict"]).where((F.col("own") >= F.col("confidence")) & (F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0))
    beaten = beaten.select("tokens", "verdict").distinct()
    return rules.join(beaten, ["tokens", "verdict"], "left_anti").select("tokens", "verdict", "confidence", "support")


def match(known: DataFrame, rules: DataFrame, words: dict[str, int]) -> DataFrame:
    """(known, mined, verdict, confidence) for each row of ``known(known)``, sets of known tokens, that holds all tokens of a
    rule: the surest such rule's. The index lists a rule under the rarest of its tokens."""
    seen = F.create_map(*[F.lit(x) for item in words.items() for x in item])
    place = F.transform("tokens", lambda t: F.struct(F.element_at(seen, t).alias("n"), t.alias("t")))
    index = rules.select(F.array_min(place)["t"].alias("token"), "tokens", "verdict", "confidence", "support")
    met = known.select("known", F.explode("known").alias("token")).join(index, "token").where(F.size(F.array_except("tokens", "known")) == 0)
    name = F.array_join("tokens", " ")
    order = F.struct(-F.col("confidence"), -F.col("support"), -F.size("tokens"), name.alias("name"))
    best = met.groupBy("known").agg(F.min_by(F.struct(name.alias("mined"), "verdict", "confidence"), order).alias("b"))
    return best.select("known", "b.mined", "b.verdict", "b.confidence")


def judge(urls: DataFrame, labelled: DataFrame, rules: tuple = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """``urls(url, ...)`` with host, path, rule, verdict, mined (the tokens of the mined rule that decided, else null)
    and confidence (its own); columns of these names are replaced. ``labelled(url, verdict)`` teaches the rules."""
    spark: SparkSession = urls.sparkSession
    ws = Workspace(spark, "url-filter")
    taught = parsed(labelled.where(F.col("verdict").isin(ALLOW, BLOCK)).select("url", "verdict")).where("host <> ''")
    taught = taught.select(tokens(F.col("url")).alias("tokens"), "verdict")
    words = vocabulary(taught, support)
    found = ws.keep(mine(taught, words, support, confidence), "rules")
    names = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict", "mined", "confidence")]
    rows = parsed(urls.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), "url")).withColumn("_given", given(rules))
    rows = rows.withColumn("tokens", F.when(F.col("_given").isNull(), tokens(F.col("url"))))
    rows = rows.select("_row", "host", "path", "_given", F.when(F.col("tokens").isNotNull(), _known(words)).alias("known"))
    decided = F.coalesce("_given.verdict", "_verdict", F.lit(ALLOW)).alias("verdict")
    if words:
        sets = rows.where("size(known) > 0").select("known").distinct()
        best = ws.keep(match(sets, found, words).withColumnRenamed("verdict", "_verdict"), "matched")
        rows = rows.join(best, "known", "left")
    else:
        rows = rows.withColumns({"mined": F.lit(None).cast("string"), "_verdict": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double")})
    return rows.select(*[F.col(f"_row.`{c}`") for c in names], "host", "path", F.col("_given.rule").alias("rule"), decided, "mined", "confidence")


def labels(urls: DataFrame, rules: tuple = RULES) -> DataFrame:
    """(url, verdict) of the urls that a given rule covers."""
    covered = parsed(urls.select("url")).withColumn("_given", given(rules)).where("_given is not null")
    return covered.select("url", F.col("_given.verdict").alias("verdict"))
