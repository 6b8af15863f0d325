"""Evaluation metrics (M1-M16) as aggregates over retrievals.

``outcomes`` turns retrievals and questions into one row a question; everything else aggregates it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import textcols as T

SETUPS = (("dense", "dense", False), ("hybrid", "hybrid", False), ("hybrid, 1 per page", "hybrid", True))
STOP_AFTER_NO_REPLY = 3
SWEEP = [round(0.20 + 0.02 * i, 2) for i in range(24)]


def outcomes(retrievals: DataFrame, questions: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a question: qid, question, answerable, abstain, top_score, want, got (arrays of pages, got
    in rank order), hit, first_hit, checked. ``truth(qid, source, page)``."""
    page = F.struct("source", F.col("page").cast("int").alias("page"))
    want = truth.groupBy("qid").agg(F.array_sort(F.collect_set(page)).alias("want"))
    got = F.transform("hits", lambda h: F.struct(h["source"].alias("source"), h["page"].cast("int").alias("page")))
    rows = retrievals.select("qid", "abstain", "top_score", got.alias("got")).join(questions.select("qid", "question", "answerable"), "qid").join(want, "qid", "left")
    rows = rows.withColumn("want", F.coalesce("want", F.array().cast("array<struct<source:string,page:int>>")))
    rows = rows.withColumn("checked", F.col("answerable") & ~F.col("abstain") & (F.size("want") > 0))
    hit = F.arrays_overlap("got", "want")
    return rows.withColumn("hit", F.col("checked") & hit).withColumn("first_hit", F.col("checked") & hit & F.array_contains("want", F.get("got", F.lit(0))))


def _pct(part, whole):
    return F.round(part / whole * 100, 1)


def evaluate(rows: DataFrame, *keys: str) -> DataFrame:
    """One row, or one for each value of ``keys``."""
    n, ans = F.count("*"), F.count_if("answerable")
    un = n - ans
    answered = F.count_if(~F.col("answerable") & ~F.col("abstain"))
    refused = F.count_if(F.col("answerable") & F.col("abstain"))
    checked = F.count_if("checked")
    some = F.nullif(checked, F.lit(0).cast("long"))
    pages = F.avg(F.when(F.col("checked"), F.size(F.array_distinct("got"))))
    return rows.groupBy(*keys).agg(
        n.alias("n_total"), ans.alias("n_answerable"), un.alias("n_unanswerable"),
        _pct(un, n).alias("unsupported_before_pct"), _pct(answered, n).alias("unsupported_after_pct"),
        _pct(refused, F.greatest(ans, F.lit(1))).alias("false_refusal_pct"),
        _pct(F.count_if("hit"), some).alias("citation_hit_rate_pct"), _pct(F.count_if("first_hit"), some).alias("first_hit_rate_pct"),
        checked.alias("answered_checked"), F.count_if("hit").alias("cited_right_page"), F.count_if("first_hit").alias("cited_right_page_first"),
        F.round(pages, 1).alias("pages_cited_avg"), (un - answered).alias("refused_unanswerable"),
    )


def latency(times: DataFrame, column: str) -> DataFrame:
    """M7: exact percentiles with linear interpolation, from a histogram of the distinct values."""
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95)))
    return times.agg(p.alias("p")).select(F.round(F.col("p")[0], 1).alias("latency_ms_p50"), F.round(F.col("p")[1], 1).alias("latency_ms_p95"))


def latency_by(times: DataFrame, column: str, *keys: str) -> DataFrame:
    """M7 for each value of ``keys``."""
    p = F.percentile(column, F.array(F.lit(0.5), F.lit(0.95)))
    return times.groupBy(*keys).agg(p.alias("p")).select(*keys, F.round(F.col("p")[0], 1).alias("latency_ms_p50"), F.round(F.col("p")[1], 1).alias("latency_ms_p95"))


def misses(rows: DataFrame) -> DataFrame:
    """M8: (kind, qid, question, top_score, wanted, cited)."""
    kind = (
        F.when(~F.col("answerable") & ~F.col("abstain"), "answered_unanswerable")
        .when(F.col("answerable") & F.col("abstain"), "refused_answerable")
        .when(F.col("checked") & ~F.col("hit"), "wrong_page")
    )
    wrong = kind == "wrong_page"
    out = rows.select(kind.alias("kind"), "qid", "question", F.when(~wrong, F.col("top_score")).alias("top_score"), F.when(wrong, T.page_labels("want")).alias("wanted"), F.when(wrong, T.page_labels("got")).alias("cited"))
    return out.where("kind is not null")


def setup_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """M9: (change, qid): fixed if only ``before`` missed the right page, lost if only ``after`` did."""
    a, b = (misses(x).where("kind = 'wrong_page'").select("qid") for x in (before, after))
    fixed = a.join(b, "qid", "left_anti").select(F.lit("fixed").alias("change"), "qid")
    return fixed.unionByName(b.join(a, "qid", "left_anti").select(F.lit("lost").alias("change"), "qid"))


def sweep(rows: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Rates at each threshold from one retrieval, since neither hits nor best scores depend on it.
    ``rows`` as from ``outcomes``; a question gives one row for each threshold (a fixed list)."""
    listed = F.array(*[F.lit(t) for t in (thresholds or SWEEP)])
    hit = F.arrays_overlap("got", "want")
    each = rows.select("answerable", "top_score", "want", "got", hit.alias("overlap"), F.explode(listed).alias("threshold"))
    each = each.withColumn("abstain", F.col("top_score") < F.col("threshold"))
    each = each.withColumn("checked", F.col("answerable") & ~F.col("abstain") & (F.size("want") > 0))
    each = each.withColumn("hit", F.col("checked") & F.col("overlap")).withColumn("first_hit", F.col("hit") & F.array_contains("want", F.get("got", F.lit(0))))
    return evaluate(each, "threshold").select("threshold", "unsupported_after_pct", "false_refusal_pct", "citation_hit_rate_pct")


def stops_after(records: DataFrame, limit: int = STOP_AFTER_NO_REPLY) -> DataFrame:
    """(run, qid): the first row of each run at which ``limit`` errors in a row are reached; there the run
    ends. ``records(run, qid, outcome)``; any reply starts the count again."""
    reached = error_streaks(records).where(F.col("streak") == limit)
    return reached.groupBy("run").agg(F.min("qid").alias("qid"))


def error_streaks(records: DataFrame) -> DataFrame:
    """(run, qid, outcome, streak): errors in a row up to each record of ``records(run, qid, outcome)``. A run's
    questions are asked one after the other, so they are one window; runs are independent."""
    w = Window.partitionBy("run").orderBy("qid")
    replies = records.withColumn("g", F.sum((F.col("outcome") != "error").cast("int")).over(w))
    own = Window.partitionBy("run", "g").orderBy("qid")
    return replies.withColumn("streak", F.sum((F.col("outcome") == "error").cast("int")).over(own)).select("run", "qid", "outcome", "streak")


def llm_metrics(records: DataFrame) -> DataFrame:
    """``records(answerable, outcome, cited, right_page)``; right_page is null where nothing was expected."""
    ans, out = F.col("answerable"), F.col("outcome")
    answered = ans & (out == "answered")
    c = lambda cond, name: F.count_if(F.coalesce(cond, F.lit(False))).alias(name)
    return records.agg(
        c(~ans, "passed_unanswerable"), c(~ans & (out == "refused"), "refused_unanswerable"), c(ans, "passed_answerable"),
        c(ans & (out == "refused"), "refused_answerable"), c(answered, "answered"), c(answered & (F.size("cited") > 0), "cite_a_passage"),
        c(answered & F.col("right_page"), "cite_right_page"), c(answered & F.col("right_page").isNotNull(), "checked_pages"), c(out == "error", "no_reply"),
    )


def llm_records(answers: DataFrame, questions: DataFrame, truth: DataFrame, hits: DataFrame) -> DataFrame:
    """Records of the questions that passed the score guard: qid, answerable, outcome, cited, right_page.
    ``answers`` as from ``answers.answer`` without the guard's own refusals; ``hits(qid, hits)``."""
    from .answers import cited_pages

    want = truth.groupBy("qid").agg(F.collect_set(F.struct("source", F.col("page").cast("int").alias("page"))).alias("want"))
    cited = cited_pages(answers.select("qid", F.col("answer").alias("text")).join(hits, "qid")).groupBy("qid").agg(F.array_sort(F.collect_set(F.struct("source", F.col("page").cast("int").alias("page")))).alias("cited"))
    rows = answers.join(questions.select("qid", "answerable"), "qid").join(cited, "qid", "left").join(want, "qid", "left")
    outcome = F.when(F.col("error").isNotNull(), "error").when(F.col("abstained"), "refused").otherwise("answered")
    none = F.array().cast("array<struct<source:string,page:int>>")
    right = F.when((outcome == "answered") & F.col("want").isNotNull(), F.arrays_overlap(F.coalesce("cited", none), "want"))
    return rows.select("qid", "answerable", outcome.alias("outcome"), F.coalesce("cited", none).alias("cited"), right.alias("right_page"))


def report(metrics: DataFrame, times: DataFrame | None = None) -> DataFrame:
    """A printable table, one line for each figure and setup. ``metrics(setup, ...)`` as from ``evaluate``;
    ``times(setup, latency_ms_p50, latency_ms_p95)`` as from ``latency_by`` adds the line of retrieval times."""
    n = F.col("answered_checked")
    lines = {
        "Right page among the citations": T.share("cited_right_page", n), "Right page cited first": T.share("cited_right_page_first", n),
        "Different pages cited (average)": F.col("pages_cited_avg").cast("string"),
    }
    if times is not None:
        metrics = metrics.join(times, "setup", "left")
        lines["Retrieval time, median / p95 (ms)"] = F.concat_ws(" / ", F.col("latency_ms_p50").cast("string"), F.col("latency_ms_p95").cast("string"))
    pairs = F.array(*[F.struct(F.lit(k).alias("figure"), v.alias("value")) for k, v in lines.items()])
    return metrics.select("setup", F.explode(pairs).alias("p")).select("setup", "p.figure", "p.value")


def guard_report(rows: DataFrame, threshold: float, top_k: int) -> DataFrame:
    """The (n, line)s above the table: what was asked, and what the guard did, which is the same for all setups.
    ``rows`` of any one setup, as from ``outcomes``."""
    counted = rows.agg(
        F.count("*").alias("n"), F.count_if("answerable").alias("ans"), F.count_if(~F.col("answerable")).alias("un"),
        F.count_if(~F.col("answerable") & ~F.col("abstain")).alias("answered"), F.count_if(F.col("answerable") & F.col("abstain")).alias("refused"),
    )
    lines = F.array(
        F.format_string("Threshold %s, top %d citations, %d questions (%d answerable, %d unanswerable).", F.lit(str(round(threshold, 3))), F.lit(top_k), "n", "ans", "un"),
        F.lit("The guard is the same in every column:"),
        F.format_string("  unanswerable questions that got an answer   %d of %d  (with no guard, all %d)", "answered", "un", "un"),
        F.format_string("  answerable questions refused                %d of %d", "refused", "ans"),
    )
    return counted.select(F.posexplode(lines).alias("n", "line")).withColumn("n", F.col("n") + 1)


# The headings of the lists of questions that went wrong.
MISS_TITLES = {
    "answered_unanswerable": "Unanswerable questions that still got an answer", "refused_answerable": "Answerable questions that were refused",
    "wrong_page": "Answered, but no citation pointed to the right page",
}
REPLY_TITLES = {
    "answered": "Unanswerable questions Mistral still answered", "refused": "Answerable questions Mistral refused",
    "wrong_page": "Answers that cite no passage from the right page", "error": "No answer from Mistral",
}


def _listed(rows: DataFrame, titles: dict[str, str]) -> DataFrame:
    """(kind, n, line) of ``rows(kind, qid, line)``: for each kind its title with the number of its questions (n = 0),
    also where there are none, then a line for each, in the order of their ids. Ranks are within a kind: a report for
    people, of the questions of one evaluation."""
    spark = rows.sparkSession
    heads = spark.createDataFrame(list(titles.items()), "kind string, title string").join(rows.groupBy("kind").agg(F.count("*").alias("c")), "kind", "left")
    heads = heads.select("kind", F.lit(0).alias("n"), F.format_string("%s (%d):", "title", F.coalesce("c", F.lit(0))).alias("line"))
    w = Window.partitionBy("kind").orderBy("qid")
    return heads.unionByName(rows.select("kind", F.row_number().over(w).alias("n"), "line"))


def miss_report(missed: DataFrame) -> DataFrame:
    """(kind, n, line), the lists of ``misses``: scores with three digits, or the pages wanted and cited."""
    score = F.when(F.col("top_score").isNull(), "  -  ").otherwise(T.fixed(F.col("top_score")))
    pages = F.concat(F.lit("  "), "question", F.lit("\n      wanted "), "wanted", F.lit("; cited "), "cited")
    line = F.when(F.col("kind") == "wrong_page", pages).otherwise(F.concat(F.lit("  "), score, F.lit("  "), "question"))
    return _listed(missed.select("kind", "qid", line.alias("line")), MISS_TITLES)


def llm_report(metrics: DataFrame, model: str) -> DataFrame:
    """The (n, line)s on the client's mode. ``metrics`` as from ``llm_metrics``."""
    of = lambda text, part, whole: F.format_string(f"  {text}%d of %d", part, whole)
    lines = F.array(
        F.format_string("Mistral mode (%s) on the %d questions the score guard let through:", F.lit(model), F.col("passed_unanswerable") + F.col("passed_answerable")),
        of("unanswerable ones it refused (second guard)   ", "refused_unanswerable", "passed_unanswerable"), of("answerable ones it refused                    ", "refused_answerable", "passed_answerable"),
        of("answers that cite a passage, like [1]         ", "cite_a_passage", "answered"), of("answers citing a passage from the right page  ", "cite_right_page", "checked_pages"),
        F.format_string("  no answer from Mistral                        %d", "no_reply"),
    )
    return metrics.select(F.posexplode(lines).alias("n", "line")).withColumn("n", F.col("n") + 1)


def reply_report(records: DataFrame) -> DataFrame:
    """(kind, n, line), the questions that went wrong in the client's mode. ``records(qid, question,
    answerable, outcome, answer, cited, right_page, error)``: the answer's first 240 characters, the error's first 200."""
    out, ans = F.col("outcome"), F.col("answerable")
    kind = (
        F.when(out == "error", "error").when(~ans & (out == "answered"), "answered").when(ans & (out == "refused"), "refused")
        .when(ans & (out == "answered") & ~F.col("right_page"), "wrong_page")
    )
    flat = F.btrim(F.regexp_replace("answer", r"(?U)\s+", " "))
    more = lambda name, c: F.when(F.coalesce(F.length(c) > 0, F.lit(False)), F.concat(F.lit(f"\n      {name}: "), c)).otherwise("")
    line = F.concat(F.lit("  "), "question", more("answer", F.left(flat, F.lit(240))), more("cited", T.page_labels("cited")), more("error", F.left("error", F.lit(200))))
    return _listed(records.select(kind.alias("kind"), "qid", line.alias("line")).where("kind is not null"), REPLY_TITLES)
