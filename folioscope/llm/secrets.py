"""Secret scans (operator 10) with DataFrame functions only.

Three fixed patterns give the base spans. A fourth kind, ``markov``, comes from two character Markov
models, one of random strings and one of ordinary identifiers: a run of key characters is a secret if
its mean log-likelihood ratio per transition reaches a threshold. Runs shorter than ``SHORT`` need more for
each character they lack; runs shorter than ``MIN_RUN`` say too little and are not scanned by the models,
nor are runs without a letter (numbers, dates, telephone numbers) and those of a UUID's form.

The models are fitted on labelled samples. Random: strings made by a rule from digests, in several alphabets.
Ordinary: identifiers made by a rule from ``WORDS``, in the usual ways of writing them, and the words of a
bounded sample of the corpus. Each of the two ordinary samples gives a model of its own, and their mean, with a
small share for every transition, is the model of ordinary strings; so neither its size nor an empty corpus
moves the threshold. Scanning is one projection over whole texts, in time linear in the length of a run: no
shuffle, no Python.

Cases: null and empty texts have no spans. Repeated rows are scanned each. A markov span that overlaps
a base span of its document is left out; base spans always stay. Control characters U+0001 and U+0002
in a text are read as U+0003, which no pattern matches. Texts of any length are scanned whole. An empty
corpus trains on the identifiers made by rule alone. Extra columns are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}+"  # 16 or more in all
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
MIN_RUN = 12  # characters of the shortest run that the models score
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RUN},}}+"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
WIDTH = len(ALPHABET)
# Words that identifiers are often made of.
WORDS = """
account active admin amount answer application array async author balance batch block book browser build bytes call
cancel cart change char child clear client code color command commit company config console container context cookie
count create current customer database debug delete device directory display domain driver editor email encoding
engine entry error exception export feature file find flag format from gateway get handler header hidden http
identifier import info input instance interface invoice iterator javascript label last length library line list local
lock main map member menu meta min mode module name next notification number offset option output package panel parent
password payment phone player point port post preview private product project protocol public queue range record
region release remove reply request resource result role route rule sample schema screen search secure send server
session setting shell simple size sort space src start static step store string subject success table target template
text thread title tool track transfer trigger unit upload user value vendor video visible web window work write year
""".split()
SAMPLE_DOCS = 2000  # documents, of least hashed id, whose words teach one of the models of ordinary strings
RANDOM_STRINGS = 4000
FORMS = 6  # identifiers made of each word, for each way of writing them
THRESHOLD = 0.9  # nats per transition; random strings of 20 characters lie above 1.3, names below 0.8
SHORT = 20
RISE = 0.015  # added to the threshold for each character below SHORT
FLOOR = 0.02  # share of every transition in the model of ordinary strings
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
BLOCK = 128
END = 2**31 - 1
SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"


def _clean(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "\x03\x03")


def _blocks(values: str) -> Column:
    """The array column ``values`` cut into arrays of ``BLOCK`` elements."""
    n = F.size(values)
    starts = F.when(n > 0, F.sequence(F.lit(0), (F.floor((n - 1) / BLOCK)).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda b: F.slice(values, b * BLOCK + 1, BLOCK))


def _before(values: Column, op: Callable[[Column, Column], Column], start: Column) -> Column:
    """For each of a few values, ``op`` over ``start`` and all values before it."""
    return F.aggregate(
        values, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"],
    )


def _running(values: str, op: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each element of the array<int> column ``values``, ``op`` over ``zero`` and all elements before it. Arrays
    that grow inside an aggregate are copied for each element, so only those of a block do, and that of the blocks."""
    sums = F.transform(_blocks(values), lambda block: F.aggregate(block, F.lit(zero), lambda a, x: op(a, x)))
    return F.flatten(F.zip_with(_blocks(values), _before(sums, op, F.lit(zero)), lambda block, at: _before(block, op, at)))


def _with_spans(docs: DataFrame, text: str, patterns: dict[str, tuple[str, int]]) -> DataFrame:
    """``docs`` with a SPAN column for each of ``patterns`` (pattern and kind): its leftmost matches, in code points.
    Each match is put between two marks, and the pieces between the marks are measured. Every array that others are
    made of is a column of its own, so that it is made once."""
    pieces = {f"{c}_p": F.when(F.col(text).rlike(p), F.split(F.regexp_replace(text, p, "\x01$0\x02"), "\x01")) for c, (p, _) in patterns.items()}
    docs = docs.withColumns(pieces)
    # The text before the first match counts with a mark, as pieces that begin with a match do.
    docs = docs.withColumns({f"{c}_n": F.transform(f"{c}_p", lambda x, i: F.length(x) - (i > 0).cast("int")) for c in patterns})
    docs = docs.withColumns({f"{c}_at": F.when(F.col(f"{c}_p").isNotNull(), _running(f"{c}_n", lambda a, x: a + x, 0)) for c in patterns})

    def found(c: str, kind: int) -> Column:
        value = lambda p: F.substring_index(p, "\x02", 1)
        span = lambda p, at: F.struct(at.alias("start"), (at + F.length(value(p))).alias("end"), F.lit(kind).alias("kind"), value(p).alias("value"))
        each = F.zip_with(F.slice(f"{c}_p", 2, F.size(f"{c}_p")), F.slice(f"{c}_at", 2, F.size(f"{c}_p")), span)
        return F.when(F.col(f"{c}_p").isNotNull(), each).otherwise(F.array().cast(SPAN))

    docs = docs.withColumns({c: found(c, kind) for c, (_, kind) in patterns.items()})
    return docs.drop(*[f"{c}_{x}" for c in patterns for x in ("p", "n", "at")])


def _transitions(words: DataFrame) -> DataFrame:
    """Counts of (previous, next) character numbers over ``words(m, w)``, for each sample ``m``; 0 is a
    character outside the alphabet."""
    w = words.select("m", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    pairs = w.select("m", F.explode(F.expr("transform(sequence(1, length(w) - 1), i -> substring(w, i, 2))")).alias("p"))
    return (
        pairs.groupBy("m", "p").count()
        .select("m", _number(F.substring("p", 1, 1)).alias("a"), _number(F.substring("p", 2, 1)).alias("b"), "count")
        .groupBy("m", "a", "b").agg(F.sum("count").alias("n"))
    )


def _number(c: Column) -> Column:
    """The character's place in the alphabet, from 1; 0 outside it."""
    return F.call_function("instr", F.lit(ALPHABET), c)


def random_strings(spark: SparkSession, n: int = RANDOM_STRINGS) -> DataFrame:
    """Labelled as random: digests of the numbers below ``n``, written in hexadecimal, base 64, letters and
    digits, capitals, and small letters."""
    d = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("d"))
    b64 = F.regexp_replace(F.base64(F.unhex("d")), "=+$", "")
    plain = F.regexp_replace(b64, "[+/]", "")
    return d.select(F.explode(F.array(F.left("d", F.lit(40)), b64, plain, F.left(F.upper(plain), F.lit(20)), F.left(F.lower(plain), F.lit(24)))).alias("w"))


def made_identifiers(spark: SparkSession) -> DataFrame:
    """Labelled as ordinary: one to three of ``WORDS`` as identifiers, with and without numbers; dates; sequences."""
    n = len(WORDS)
    words = F.array(*[F.lit(w) for w in WORDS])
    i, j = (F.col("id") / FORMS).cast("int"), (F.col("id") % FORMS).cast("int")
    word = lambda k: F.element_at(words, ((i * 7 + j * 31 + k * 13) % n + 1).cast("int"))
    parts = F.slice(F.array(F.element_at(words, i + 1), word(1), word(2), word(3)), 1, 2 + j % 3)
    rows = spark.range(n * FORMS).select("id", parts.alias("p"), (F.col("id") % 100).cast("string").alias("k"), F.transform(parts, lambda w: F.initcap(w)).alias("c"))
    first, capitals = F.col("p")[0], F.array_join("c", "")
    camel = F.concat(first, F.array_join(F.slice("c", 2, F.size("c") - 1), ""))
    ways = [*[F.array_join("p", sep) for sep in ("_", "-", "/", "")], camel, capitals, *[F.upper(F.array_join("p", sep)) for sep in ("_", "-", "")]]
    numbered = [F.concat(first, F.lit(sep), "k") for sep in ("_", "=")] + [F.concat(first, "k", F.lit("_"), F.col("p")[1]), F.concat_ws("=", first, F.col("p")[1])]
    names = rows.select(F.explode(F.array(*ways, *[F.concat(w, "k") for w in ways], *numbered)).alias("w"))
    day = F.timestamp_seconds(F.col("id") * 3_000_017)
    dates = spark.range(400).select(F.explode(F.array(F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM-dd'T'HH-mm-ss"), F.date_format(day, "yyyy/M/d"))).alias("w"))
    rows_of_keys = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
    fixed = [r for k in rows_of_keys for r in (k, k.upper())] + [c * 12 for c in ALPHABET]
    sequences = spark.createDataFrame([(w,) for w in fixed for _ in range(10)], "w string")
    return names.unionByName(dates).unionByName(sequences)


def corpus_words(docs: DataFrame, n: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled as ordinary: the letter runs of at most ``n`` documents, those of least hashed id (a bounded
    sample, for training alone)."""
    # Ids alone are sorted; at most n of them go to the tasks that read the texts.
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")
    return some.select(F.explode(F.regexp_extract_all(_clean(F.col("text")), F.lit(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("w"))


def _smoothed(counts: list[list[float]], prior: list[list[float]], weight: float) -> list[list[float]]:
    """Transition probabilities: counts with ``weight`` more observations in each row, spread as ``prior`` has it."""
    return [[(x + weight * q) / (sum(row) + weight) for x, q in zip(row, own, strict=True)] for row, own in zip(counts, prior, strict=True)]


def fit(docs: DataFrame) -> list[float]:
    """Log-likelihood ratios by transition, row by row of a square of ``WIDTH + 1`` numbers."""
    spark, size = docs.sparkSession, WIDTH + 1
    samples = [random_strings(spark), made_identifiers(spark), corpus_words(docs)]
    words = samples[0].withColumn("m", F.lit(0))
    for m, sample in enumerate(samples[1:], start=1):
        words = words.unionByName(sample.withColumn("m", F.lit(m)))
    counts = [[[0.0] * size for _ in range(size)] for _ in samples]
    for r in _transitions(words).collect():  # a row for each sample and pair of characters
        counts[r.m][r.a][r.b] += r.n
    even = [[1 / size] * size for _ in range(size)]
    random, made = _smoothed(counts[0], even, size), _smoothed(counts[1], even, size / 5)
    read = _smoothed(counts[2], made, 300)
    ordinary = [[(1 - FLOOR) * (x + y) / 2 + FLOOR / size for x, y in zip(p, q, strict=True)] for p, q in zip(made, read, strict=True)]
    return [math.log(random[a][b] / ordinary[a][b]) for a in range(size) for b in range(size)]


def _ratio(value: Column, table: Column) -> Column:
    """Mean log-likelihood ratio of a run's inner transitions, in one pass over its characters."""
    numbers = F.transform(F.split(value, ""), _number)
    summed = F.aggregate(
        numbers,
        F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum")),
        lambda acc, x: F.struct(
            x.alias("last"),
            F.when(acc["last"] < 0, 0.0).otherwise(acc["sum"] + F.element_at(table, (F.greatest(acc["last"], F.lit(0)) * (WIDTH + 1) + x + 1).cast("int"))).alias("sum"),
        ),
        lambda acc: acc["sum"],
    )
    return summed / (F.length(value) - 1)


def _least(value: Column, threshold: float) -> Column:
    """The ratio a run needs, by its length."""
    return F.lit(threshold) + F.lit(RISE) * F.greatest(F.lit(SHORT) - F.length(value), F.lit(0))


def _scan(docs: DataFrame, model: list[float] | None, threshold: float) -> DataFrame:
    """``_row`` (all columns of ``docs``, so that no name can clash), ``base`` and ``found``."""
    table = F.lit(model if model is not None else fit(docs))
    group2 = lambda v: F.regexp_extract(v, ASSIGN, 2)
    each = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _clean(F.col("text")).alias("_text"))
    each = _with_spans(each, "_text", {"_assign": (ASSIGN, 0), "_access": (ACCESS, 1), "_hex": (HEX, 2), "_markov": (RUN, 3)})
    each = each.withColumns({
        "base": F.array_sort(F.concat(F.filter("_assign", lambda s: F.length(group2(s["value"])) >= 8), "_access", "_hex"), _by_start),
        "_markov": F.filter("_markov", lambda s: s["value"].rlike("[A-Za-z]") & ~s["value"].rlike(UUID) & (_ratio(s["value"], table) >= _least(s["value"], threshold))),
    }).select("_row", "base", "_markov")
    # Both kinds in order: a model's span overlaps a base span if one before it ends later than it starts, or one
    # behind it starts earlier than it ends.
    each = each.withColumn("_both", F.array_sort(F.concat("base", "_markov"), _by_start))
    each = each.withColumns({
        "_ends": F.transform("_both", lambda s: F.when(s["kind"] < 3, s["end"]).otherwise(0)),
        "_starts": F.transform(F.reverse("_both"), lambda s: F.when(s["kind"] < 3, s["start"]).otherwise(END)),
    })
    each = each.withColumns({"_ended": _running("_ends", F.greatest, 0), "_next": F.reverse(_running("_starts", F.least, END))})
    # Zipped, not looked up by place: a column that one lambda alone reads would be made anew for each element.
    zipped = F.arrays_zip("_both", "_ended", "_next")
    clear = lambda z: (z["_both"]["kind"] < 3) | ((z["_ended"] <= z["_both"]["start"]) & (z["_next"] >= z["_both"]["end"]))
    found = F.transform(F.filter(zipped, clear), lambda z: z["_both"])
    return each.select("_row", "base", F.when(F.size("_markov") > 0, found).otherwise(F.col("base")).alias("found"))


def scan(docs: DataFrame, model: list[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``base`` and ``found``: arrays of (start, end, kind number, value), sorted by start
    and then kind; ``found`` holds the base spans too, and columns of these names are replaced. The
    model is fitted on ``docs`` if not given."""
    keep = [f"_row.`{c}`" for c in docs.columns if c not in ("base", "found")]
    return _scan(docs, model, threshold).select(*keep, "base", "found")


def _by_start(a: Column, b: Column) -> Column:
    key = lambda s: s["start"].cast("long") * 4 + s["kind"]
    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)


def digest_text(spans: str) -> Column:
    """kind:start:end of every span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, model: list[float] | None = None) -> DataFrame:
    """``docs`` with every found span replaced by ``[SECRET]``; n_chars follows if there is such a column.

    Overlapping spans become one replacement. Columns and rows stay as they were. The text is cut into pieces of
    ``BLOCK`` code points first: finding a place in a text takes time in proportion to the place."""
    found = _scan(docs, model, THRESHOLD).withColumn("_ends", F.transform("found", lambda s: s["end"]))
    found = found.withColumns({
        "_done": F.concat(_running("_ends", F.greatest, 0), F.array(F.coalesce(F.array_max("_ends"), F.lit(0)))),  # replaced before each span, and in all
        "_cut": F.when(F.size("found") > 0, F.regexp_extract_all(F.col("_row.text"), F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))),
        "_n": F.length("_row.text"),
    })
    block = lambda x: F.floor(x / BLOCK).cast("int")

    def between(lo: Column, hi: Column) -> Column:
        """The text from ``lo`` to ``hi``, which must lie behind it."""
        own = lambda c: F.substring(F.get("_cut", c), F.greatest(lo - c * BLOCK, F.lit(0)) + 1, F.least(hi - c * BLOCK, F.lit(BLOCK)) - F.greatest(lo - c * BLOCK, F.lit(0)))
        return F.array_join(F.transform(F.sequence(block(lo), block(hi - 1)), own), "")

    def kept(s: Column, done: Column) -> Column:
        return F.when(s["start"] > done, F.concat(between(done, s["start"]), F.lit("[SECRET]"))).when(s["start"] == done, "[SECRET]").otherwise("")

    last = F.element_at("_done", -1)
    pieces = F.concat(F.zip_with("found", F.slice("_done", 1, F.size("found")), kept), F.array(F.when(last < F.col("_n"), between(last, F.col("_n"))).otherwise("")))
    text, changed = F.col("_row.text"), F.size("found") > 0
    found = found.withColumn("_new", F.when(changed, F.array_join(pieces, "")).otherwise(text))
    new = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("_new").cast("long")).otherwise(F.col("_row.n_chars"))
    return found.select(*[new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in docs.columns])
