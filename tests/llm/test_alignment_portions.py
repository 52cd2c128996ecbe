"""What a task of the tokenizer alignment holds: portions of few rows a file, whose units are tokenized together."""

from __future__ import annotations

import glob

import numpy as np

from promptlake.llm import token_alignment as ta
from promptlake.llm.common import materialize

UNITS = ["the", "don't", " lead", "trail ", "a  b", "漢字", "é😀", "x" * 300, "12,345.67", "a\nb", "tab\tbed", "▁", "the\x1c", "<|endoftext|>", "word"]


def test_units_laid_out_are_those_tokenized_alone(monkeypatch):
    sides = ta._sides(ta.default_vocabulary(), ta.default_pieces())
    want = ta._tokens(UNITS, sides)
    for call in (1, 2, 500):
        monkeypatch.setattr(ta, "CALL", call)
        laid, ends, bad = ta.laid_out(UNITS, sides)
        assert bad.tolist() == [x is None for x in want]
        for k, (ids, tops) in enumerate(laid):
            edges = np.concatenate([[0], np.searchsorted(tops, ends, "right")])
            for i, own in enumerate(want):
                part = slice(edges[i], edges[i + 1])
                begin = ends[i - 1] if i else 0
                assert ids[part].tolist() == ([] if own is None else own[k][0].tolist())
                assert (tops[part] - begin).tolist() == ([] if own is None else own[k][1].tolist())


def test_a_file_of_large_rows_has_few(spark):
    found = materialize(spark.range(0, 10, 1, 1), "few", 4)
    assert found.count() == 10 and len(glob.glob(found.written_to.removeprefix("file://") + "/*.parquet")) == 3
    assert ta.PORTIONS * ta.PORTION <= 2_000_000
