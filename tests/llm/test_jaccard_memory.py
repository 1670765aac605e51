"""The comparison of bitmaps stays within a bound of bytes, whatever the size of the sets."""

import tracemalloc

import numpy as np
import pyarrow as pa

from tulkki.llm.ngram_jaccard import Bitmaps, _compare, parity


def _block(classes: int, grams: int) -> pa.RecordBatch:
    rng = np.random.default_rng(grams)
    base = rng.integers(0, 1 << 63, grams, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[i % 7:], rng.integers(0, 1 << 63, 1 + i % 5, dtype=np.uint64)])) for i in range(classes)]
    same = lambda t, v=0: pa.array(np.full(classes, v), t)
    return pa.RecordBatch.from_arrays(
        [same(pa.int64()), same(pa.int32()), same(pa.int32()), same(pa.int32()), pa.array(np.arange(classes)), pa.array(np.arange(classes)),
         pa.array([len(s) for s in sets], pa.int32()), same(pa.int32()), pa.array([parity(s) for s in sets], pa.binary())],
        names=["gram", "i", "j", "side", "node", "root", "n", "at", "bitmap"])


def test_a_block_of_large_sets_takes_little_memory():
    batch = _block(512, 5000)
    tracemalloc.start()
    pairs = sum(out.num_rows for out in _compare(80)(iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pairs == 512 * 511 // 2
    assert peak < 60 << 20


def test_portions_give_what_all_pairs_at_once_give(monkeypatch):
    batch = _block(60, 900)
    x, y = np.triu_indices(60, 1)
    whole = Bitmaps(batch.column("bitmap")).apart(x, y)
    monkeypatch.setattr("tulkki.llm.ngram_jaccard.AT_ONCE_BYTES", 1)
    assert (Bitmaps(batch.column("bitmap").slice(0)).apart(x, y) == whole).all()
    part = Bitmaps(batch.slice(10, 20).column("bitmap"))
    inside = (x >= 10) & (x < 30) & (y >= 10) & (y < 30)
    assert (part.apart(x[inside] - 10, y[inside] - 10) == whole[inside]).all()
