import hashlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from verdance.llm import base, repeats, suffix_index, suffix_tree


def _expect_bytes(rows, length):
    gone = brute.removed_bytes([t for _, t in rows], length)
    return Counter((i, len(g), int(g.sum()), brute.runs(g), hashlib.sha256(np.frombuffer((t or "").encode(), np.uint8)[~g].tobytes()).hexdigest()) for (i, t), g in zip(rows, gone))


def _expect_words(rows, window):
    gone = brute.removed_words([t for _, t in rows], window)
    return Counter((i, len(g), int(g.sum()), hashlib.sha256(" ".join(w for w, x in zip(brute.words(t), g) if not x).encode()).hexdigest()) for (i, t), g in zip(rows, gone))


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_suffix_arrays_remove_what_brute_force_removes(docs, rows, hot):
    found = suffix_index.deduplicated(docs, hot=hot).select("doc_id", "n_bytes", repeats.count_removed(), F.size("removed"), F.sha2("kept", 256))
    assert Counter(map(tuple, found.collect())) == _expect_bytes(rows, 400)


@pytest.mark.parametrize("hot", [repeats.HOT, 2])
def test_suffix_trees_remove_what_brute_force_removes(docs, rows, hot):
    found = suffix_tree.deduplicated(docs, hot=hot).select("doc_id", "n_words", repeats.count_removed(), F.sha2("kept", 256))
    assert Counter(map(tuple, found.collect())) == _expect_words(rows, 35)


def test_empty_tables(empty):
    assert suffix_index.deduplicated(empty).count() == 0
    assert suffix_tree.deduplicated(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=6), st.integers(2, 8))
def test_equal_windows_have_equal_anchors(texts, window):
    core = max(1, window // 2)
    data = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(b) for b in data])]).astype(np.int64)
    f = repeats.anchors(base.BYTE_VALUE[np.frombuffer(b"".join(data), np.uint8)], off, window, core)
    covered, place = Counter(), {}
    for d, s, n, at, c in zip(f["doc"], f["start"], f["n"], f["at"], f["core"]):
        for j in range(n):
            covered[d, s + j] += 1
            w = data[d][s + j:s + j + window]
            assert place.setdefault(w, (c, at - j)) == (c, at - j)
    assert covered == Counter((d, i) for d, b in enumerate(data) for i in range(len(b) - window + 1))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.integers(1, 30))
def test_family_of_suffix_arrays_marks_repeats(values, batch):
    names = np.array(values, np.uint64)
    family = suffix_index.Family(len(names))
    for lo in range(0, len(names), batch):
        part = names[lo:lo + batch]
        family.add([part, part + np.uint64(1)], np.arange(lo, lo + len(part)), np.ones(len(part), np.int64))
    count = Counter(values)
    assert family.marks.tolist() == [count[v] > 1 for v in values]
    sizes = [len(r) for r in family.levels]
    assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=8, max_size=150), st.integers(2, 7), st.integers(1, 3), st.integers(2, 20))
def test_tree_of_prefix_groups_marks_repeats(values, window, prefix, group):
    import pandas as pd

    v = np.array(values, np.uint64)
    n = len(v) - window + 1
    held = repeats.Held(pd.DataFrame({"n": [n], "copies": [1]}), v, np.array([0]))
    got = suffix_tree.judge(window, prefix, group)(held)
    seen = Counter(tuple(values[i:i + window]) for i in range(n))
    assert got.tolist() == [seen[tuple(values[i:i + window])] > 1 for i in range(n)]


def _cuts(data, n, key=1):
    import pandas as pd

    pieces = [hash(d) & 0xFFFFFFFF for d in data]
    rows = [(key, p, i, i, 1, 2 * i, n, d) for i, (p, d) in enumerate(sorted(zip(pieces, data)))]
    return pd.DataFrame(rows, columns=["key", "piece", "core", "context", "copies", "first", "n", "data"])


def test_equal_cuts_of_a_hot_key_are_held_once():
    """op1, op4 at 6 GB: a key with many equal cuts was held with all their bytes."""
    common = bytes(range(100)) * 5
    f = _cuts([common[:420]] * 3000 + [b"x" * 9 + common[9:420]], 21)
    parts = [f[:1000], f[1000:2500], f[2500:]]
    held = []
    judge = suffix_index.judge(400)
    whole = list(base.whole_groups(repeats.folded(iter(parts)), ["key"], 100))
    out = repeats.judged(whole[0], lambda h: held.append(h) or judge(h), by_words=False)
    assert len(whole) == 1 and len(held[0].frame) == 2 and len(held[0].values) == 840
    got = {c: [tuple(r.values()) for r in x] for c, x in zip(out["context"], out["runs"])}
    odd = [i for i, d in enumerate(f["data"]) if d[:1] == b"x"]
    assert got == {i: [(2 * i + (9 if i in odd else 0), 2 * i + 21)] for i in range(3001)}


def test_a_batch_of_suffixes_is_named_at_a_time():
    """op1 at 6 GB: all bytes of a task's contexts had 64-bit values and sums at once, 46 bytes for each byte."""
    import tracemalloc

    import pandas as pd

    rng = np.random.default_rng(1)
    data = [rng.integers(0, 255, 424, dtype=np.uint8).tobytes() for _ in range(10_000)]
    held = repeats.hold(pd.DataFrame({"n": 25, "copies": 1, "data": data}), by_words=False)
    tracemalloc.start()
    marks = suffix_index.judge(400)(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not marks.any() and peak < 60e6


@pytest.mark.parametrize("size", [1, 7, 100])
def test_whole_groups_are_whole(size):
    import pandas as pd

    key = np.sort(np.random.default_rng(2).integers(0, 12, 500))
    frame = pd.DataFrame({"key": key, "i": range(500)})
    out = list(base.whole_groups((frame[i:i + size] for i in range(0, 500, size)), ["key"], 50))
    assert np.concatenate([f["i"] for f in out]).tolist() == list(range(500))
    assert sum(f["key"].nunique() for f in out) == 12 and len(out) > 4


@given(st.lists(st.lists(st.tuples(st.integers(0, 40), st.integers(1, 12)), max_size=6), max_size=5))
def test_merged_stretches(docs):
    flat = [(a, a + n) for d in docs for a, n in d]
    lo, hi = (np.array([x[i] for x in flat], np.int32) for i in (0, 1))
    doc, lo, hi = repeats.merged(np.array([len(d) for d in docs], np.int32), lo, hi)
    expect = []
    for i, d in enumerate(docs):
        for a, n in sorted(d):
            if expect and expect[-1][0] == i and a <= expect[-1][2]:
                expect[-1][2] = max(expect[-1][2], a + n)
            else:
                expect.append([i, a, a + n])
    assert [list(map(int, x)) for x in zip(doc, lo, hi)] == expect


@pytest.mark.parametrize("module,column", [(suffix_index, "n_bytes"), (suffix_tree, "n_words")])
def test_contexts_without_a_repeat(spark, module, column):
    """op1, op4: the first error at 6 GB, a bundle of contexts of which none is repeated."""
    common = " ".join(f"common{i}x" for i in range(34))
    rows = [(k, " ".join(f"{k}left{i}" for i in range(60)) + " " + common + " " + " ".join(f"{k}right{i}" for i in range(60))) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = module.deduplicated(docs).select("doc_id", column, F.size("removed"))
    assert sorted(map(tuple, found.collect())) == [(k, len(t.encode()) if column == "n_bytes" else 154, 0) for k, t in rows]
