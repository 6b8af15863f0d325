import random

from pyspark.sql import functions as F

from folioscope.operators import chunking, layout
from folioscope.settings import Settings

SCHEMA = "source string, page int, ord int, x0 double, y0 double, x1 double, y1 double, mid double, text string, block_type int"


def page(spark, boxes):
    return spark.createDataFrame([("d.pdf", 1, k, float(x0), float(y0), float(x1), y0 + 10.0, 306.0, t, 0) for k, (x0, y0, x1, t) in enumerate(boxes)], SCHEMA)


def order(spark, boxes):
    return [r.text for r in layout.read_order(page(spark, boxes)).orderBy("pos").collect()]


def test_one_column_reads_top_to_bottom(spark):
    assert order(spark, [(50, 300, 560, "c"), (50, 100, 560, "a"), (50, 200, 290, "b")]) == ["a", "b", "c"]


def test_two_columns_read_one_after_the_other(spark):
    boxes = [(50, 50, 560, "title")] + [(50, 100 * k, 290, f"l{k}") for k in (1, 2, 3)] + [(320, 100 * k + 52, 560, f"r{k}") for k in (1, 2, 3)]
    random.Random(1).shuffle(boxes)
    assert order(spark, boxes) == ["title", "l1", "l2", "l3", "r1", "r2", "r3"]


def test_wide_block_ends_a_band(spark):
    boxes = [(50, 100, 290, "l1"), (50, 200, 290, "l2"), (50, 400, 290, "l3"), (320, 100, 560, "r1"), (320, 200, 560, "r2"), (320, 400, 560, "r3"), (50, 300, 560, "caption")]
    assert order(spark, boxes) == ["l1", "l2", "r1", "r2", "caption", "l3", "r3"]


def test_noisy_wide_block_still_ends_a_band_and_images_go(spark):
    long = "This is a long enough sentence about {}."
    df = page(spark, [(50, 100, 290, long.format("left one")), (320, 100, 560, long.format("right one")), (50, 200, 560, "7"), (50, 300, 290, long.format("left two"))])
    image = df.where("ord = 0").withColumn("block_type", F.lit(1)).withColumn("ord", F.lit(9))
    got = [r.text for r in layout.page_blocks(df.unionByName(image)).orderBy("pos").collect()]
    assert got == [long.format(x) for x in ("left one", "right one", "left two")]


def packed(spark, blocks, settings=None):
    df = spark.createDataFrame([("d.pdf", 1, k, b) for k, b in enumerate(blocks)], "source string, page int, pos int, text string")
    return [r.text for r in chunking.pack_pages(df, settings).orderBy("i").collect()]


def words(n, tag):
    return (f"{tag} word " * n)[:n]


def test_limit_and_overlap(spark):
    blocks = [words(310, f"b{k}").strip() for k in range(6)]
    got = packed(spark, blocks)
    assert len(got) > 2 and all(len(c) <= 900 for c in got)
    for a, b in zip(got, got[1:], strict=False):
        assert b.startswith(a[-150:] + " ")


def test_long_block_is_split_at_sentences(spark):
    got = packed(spark, [" ".join(f"This is sentence number {k} of the block." for k in range(60))])
    assert len(got) > 1 and all(c.endswith(".") and len(c) <= 900 for c in got)


def test_overlap_shrinks_to_fit(spark):
    got = packed(spark, ["a" * 479, "b" * 839])
    assert len(got) == 2 and len(got[1]) == 900 and got[1] == "a" * 60 + " " + "b" * 839


def test_no_overlap_loses_and_repeats_nothing(spark):
    blocks = [words(310, f"b{k}").strip() for k in range(6)]
    assert " ".join(packed(spark, blocks, Settings(chunk_overlap=0))) == " ".join(blocks)


def test_long_block_carries_no_overlap_either_way(spark):
    got = packed(spark, ["x" * 300, "y. " * 400, "z" * 300])
    assert got[0] == "x" * 300 and got[-1] == "z" * 300


def test_one_long_sentence_stays_whole(spark):
    assert packed(spark, ["q" * 2000]) == ["q" * 2000]


def test_chunk_numbers_have_gaps_and_pages_are_bounds(spark):
    df = spark.createDataFrame([("a.b.pdf", 2, 1, "s" * 60), ("a.b.pdf", 3, 1, "x" * 50), ("a.b.pdf", 3, 2, "w" * 1000), ("a.b.pdf", 4, 1, "v" * 130)], "source string, page int, pos int, text string")
    got = sorted((r.chunk_id, r.doc_id, r.page) for r in chunking.chunk_table(df).collect())
    assert got == [("a.b::p3::c1", "a.b", 3), ("a.b::p4::c0", "a.b", 4)]


def test_skipped_documents(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "source string")
    assert [r.source for r in chunking.skipped(docs, docs.where("source = 'a'")).collect()] == ["b"]


def test_against_a_plain_loop(spark):
    def plain(blocks, limit=900, keep=150):
        out = []

        def fold(pieces):
            buf = None
            for p in pieces:
                if buf is None:
                    buf = p
                elif len(buf) + 1 + len(p) > limit:
                    out.append(buf)
                    n = min(keep, limit - len(p) - 1)
                    buf = f"{buf[-n:]} {p}" if n > 0 else p
                else:
                    buf += " " + p
            if buf is not None:
                out.append(buf)

        run = []
        for b in blocks:
            if len(b) > limit:
                fold(run)
                run = []
                fold(b.split("|"))
            else:
                run.append(b)
        fold(run)
        return out

    r = random.Random(3)
    for _ in range(4):
        blocks = ["".join(r.choice("abc") for _ in range(r.choice((30, 200, 500, 899, 950)))) for _ in range(12)]
        assert packed(spark, blocks) == plain(blocks)
