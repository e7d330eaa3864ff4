"""What every embedder gets from the common part."""

import numpy as np
import pytest

from passageworks.operators.embed import Embedder, HashEmbedder, embed_table, hash_embed


class Picky(Embedder):
    """Fails for a whole batch if one text is bad, and gives NaN for another."""

    calls = 0

    def encode(self, texts):
        self.calls += 1
        if "bad" in texts:
            raise ValueError("bad text")
        return np.array([[len(x), np.nan if x == "nan" else 1.0] for x in texts])


def test_rows_that_fail_are_skipped_and_no_others():
    own = Picky()
    assert own.embed(["a", None, "bad", "nan", "abc"]) == [[1.0, 1.0], None, None, None, [3.0, 1.0]]
    assert own.calls == 6  # the dimension is asked of a batch once: the batch, four alone, and that
    assert own.dimension == 2 and own.embed([]) == []
    with pytest.raises(ValueError):
        own.embed_one("bad")
    assert own.embed_one("ab") == [2.0, 1.0]


def test_batches_are_cut(monkeypatch):
    monkeypatch.setattr("passageworks.operators.embed.BATCH", 2)
    assert [v[0] for v in Picky().embed(["a", "ab", "abc", "bad", "abcd"]) if v] == [1, 2, 3, 4]


def test_tables(spark):
    rows = spark.createDataFrame([(1, "The mill, the MILL"), (2, "..."), (3, None), (1, "dam")], "k long, t string")
    got = embed_table(rows, "k", "t", HashEmbedder(8)).collect()
    assert [r["embedding"] is None for r in got] == [False, True, True, False] and all(len(r["embedding"]) == 8 for r in got if r["embedding"])
    buckets = hash_embed(rows.where("k = 1 AND t <> 'dam'"), "k", "t", 8).collect()
    dense = np.zeros(8)
    for r in buckets:
        dense[r["bucket"]] += r["v"]
    assert dense.tolist() == got[0]["embedding"]
    assert embed_table(rows.limit(0), "k", "t", HashEmbedder()).count() == 0
