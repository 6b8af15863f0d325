import json

import pytest

from folioscope import settings
from folioscope.sources import blocks


def test_settings_precedence(tmp_path):
    (tmp_path / ".env").write_text("# note\nTOP_K=7\nSIM_THRESHOLD='0.4'\nexport RETRIEVAL_MODE=dense\n\n")
    s = settings.from_env({"TOP_K": "9", "DISTINCT_PAGES": "0"}, tmp_path / ".env")
    assert (s.top_k, s.sim_threshold, s.retrieval_mode, s.distinct_pages) == (9, 0.4, "dense", False)
    assert settings.from_env({"DISTINCT_PAGES": "no"}).distinct_pages is True
    assert settings.from_env({}, tmp_path / "none") == settings.Settings()


def test_pages_count_from_one_and_blank_pages_count(spark, tmp_path):
    for name in ("b.pdf", "a.pdf", "note.txt"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.pdf").write_bytes(b"c")
    files = blocks.pdf_files(spark, f"file://{tmp_path}")
    assert sorted(r.source for r in files.collect()) == ["a.pdf", "b.pdf"]

    def parser(content):
        yield 306.0, []
        yield 300.0, [(1, 2, 3, 4, f"text of {content.decode()}", 0, 0), (1, 2, 3, 4, "image", 1, 1), (1, 2)]

    got = sorted((r.source, r.page, r.ord, r.mid, r.text, r.block_type) for r in blocks.parse_pages(files, parser).collect())
    assert got == [(n, 2, k, 300.0, t, k) for n in ("a.pdf", "b.pdf") for k, t in enumerate((f"text of {n}", "image"))]
    empty = tmp_path / "empty"
    empty.mkdir()
    with pytest.raises(blocks.NoInput):
        blocks.pdf_files(spark, f"file://{empty}")


def test_question_rows(spark, tmp_path):
    p = tmp_path / "q.jsonl"
    p.write_text(json.dumps({"question": "a", "answerable": True, "expected_pages": [{"source": "x", "page": 2}]}) + "\n\n" + json.dumps({"question": "b", "answerable": False}) + "\n")
    got = blocks.questions(spark, f"file://{p}").collect()
    assert [(r.question, r.answerable, r.absent) for r in got] == [("a", True, None), ("b", False, None)] and got[0].expected_pages[0].page == 2
    p.write_text('{"question": "a"}\n')
    with pytest.raises(Exception, match="bad question row"):
        blocks.questions(spark, f"file://{p}").collect()
