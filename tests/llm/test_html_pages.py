"""The extractor on pages written by hand, none of them made by the training pages' rules: the exact text of each."""

import pytest

from tessera.llm import html_extract as h
from tests.llm.written_pages import PAGES


@pytest.mark.parametrize("seed", [3, 4])
def test_every_written_page(seed):
    model = h.default_model(seed=seed)
    wrong = [(i, got, blocks) for i, (page, blocks) in enumerate(PAGES) for got in [h.main_text(page, model)] if got != "\n".join(blocks)]
    assert not wrong, wrong


def test_written_pages_as_a_table(spark):
    rows = [(i, f"u{i}", page) for i, (page, _) in enumerate(PAGES)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in h.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: (text, len(text)) for i, (_, blocks) in enumerate(PAGES) for text in ["\n".join(blocks)]}
