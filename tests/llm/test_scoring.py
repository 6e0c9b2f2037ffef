import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tests.llm import brute
from verdance.llm import ctw, quality


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 7 == 2


def plain_tree(strings: Counter, depth: int):
    """Predictions of a context tree by plain recursion over its definition."""
    nodes = [dict() for _ in range(depth + 1)]
    for (context, byte), n in strings.items():
        for d in range(depth + 1):
            for bit in range(8):
                key = (context[len(context) - d:], bit, byte >> (8 - bit))
                z = nodes[d].setdefault(key, [0, 0])
                z[byte >> (7 - bit) & 1] += n
    own = [{k: float(ctw.log_estimate(np.array(float(z[0])), np.array(float(z[1])))) for k, z in level.items()} for level in nodes]
    whole = [dict() for _ in nodes]
    whole[depth] = dict(own[depth])
    for d in range(depth - 1, -1, -1):
        below = Counter()
        for (c, bit, bits), w in whole[d + 1].items():
            below[c[1:], bit, bits] += w
        whole[d] = {k: np.logaddexp(own[d][k], below[k]) - math.log(2) for k in nodes[d]}

    def log10(context: bytes, byte: int) -> float:
        total = 0.0
        for bit in range(8):
            p = None
            for d in range(depth, -1, -1):
                key = (context[len(context) - d:], bit, byte >> (8 - bit))
                if key not in nodes[d]:
                    continue
                z = nodes[d][key]
                kt = (z[byte >> (7 - bit) & 1] + 0.5) / (sum(z) + 1)
                stay = 1.0 if d == depth else math.exp(own[d][key] - math.log(2) - whole[d][key])
                p = kt if p is None else stay * kt + (1 - stay) * p
            total += math.log10(0.5 if p is None else p)
        return total

    return log10


def test_scores_are_those_of_the_plain_tree(spark, docs, rows):
    few = [(i, t) for i, t in rows if len(t or "") < 4000]
    df = spark.createDataFrame(few, "doc_id long, text string")
    strings = Counter()
    for i, t in few:
        if not held(i):
            b = b"\0" * 4 + low(t).encode()
            strings.update((b[k - 4:k], b[k]) for k in range(4, len(b)))
    log10 = plain_tree(strings, 4)
    got = sorted(((r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.score) for r in ctw.scored(df).collect()))
    want = []
    for i, t in few:
        b = b"\0" * 4 + low(t).encode()
        want.append((i is not None, i or 0, len(b) - 4, sum(log10(b[k - 4:k], b[k]) for k in range(4, len(b)))))
    for g, w in zip(got, sorted(want), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9)


def test_divided_pairs_and_parts_give_the_same(spark, docs, monkeypatch):
    key = lambda r: (r.doc_id is not None, r.doc_id or 0, r.n_bytes, r.score)
    want = sorted(key(r) for r in ctw.scored(docs, depth=5).collect())
    monkeypatch.setattr(ctw, "ASKED", 300)
    got = sorted(key(r) for r in ctw.scored(docs, depth=5, most=40).collect())
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], rel=1e-9, abs=1e-9)


def test_packs_keep_strings():
    rng = np.random.default_rng(1)
    for depth in (3, 6, 7):
        keys = np.unique(rng.integers(0, 1 << 40, 500).astype(np.uint64) & np.uint64((1 << 8 * (depth - 1)) - 1)) | np.uint64(0xFEFF << 8 * (depth - 1))
        n = rng.integers(0, 1 << 50, len(keys))
        assert (ctw.unpack_keys(ctw.pack_keys(keys, depth), len(keys), 0xFEFF, depth) == keys).all()
        assert (ctw.unpack_counts(ctw.pack_counts(n), len(n)) == n).all()
        assert (ctw.turned(ctw.turned(keys, depth), depth) == keys).all()
    x = -rng.random(500) * 9
    assert ctw.unpack_values(ctw.pack_values(x), 500) == pytest.approx(x, rel=2e-10)


def test_base_scores(docs, rows):
    got = ctw.scored(docs).collect()
    words = lambda t: [*brute.words(low(t)), None]
    c = Counter(w for i, t in rows if not held(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)), 6)) for i, t in rows)
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want


def test_predictions_of_a_context_sum_to_one():
    keys = np.array([int.from_bytes(b"ab" + bytes([x]), "big") for x in b"aab"], np.uint64)
    keys, n = np.unique(keys, return_counts=True)
    full = np.array([int.from_bytes(b"ab" + bytes([x]), "big") for x in range(256)], np.uint64)
    counts = np.zeros(256)
    counts[(keys & np.uint64(255)).astype(int)] = n
    total = np.zeros(256)
    for bit in range(8):
        t = ctw.Tree(full, counts, bit, 0, 2)
        total += np.log(t.predicted()[0])
    assert np.exp(total).sum() == pytest.approx(1)


def test_log_gamma():
    for x in (0.5, 1.0, 3.25, 100.5, 1e6):
        assert float(ctw.log_gamma(np.array(x))) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_nothing_to_score(empty):
    assert ctw.scored(empty).count() == 0


def test_statistics(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.statistics(docs).collect())
    assert got == Counter((i, *brute.base_statistics(t)) for i, t in rows)


def plain_mcd(x: np.ndarray, s: quality.Settings) -> np.ndarray:
    """Scaled squared distances of one group, by NumPy."""
    def order(v, q):
        b = np.sort(np.round(v * 50))
        return b[int(np.ceil(q * len(b))) - 1] / 50

    ridge = np.diag(np.array(s.ridge) ** 2)
    middle = np.all([(np.round(c * 50) >= np.round(order(c, 0.1) * 50)) & (np.round(c * 50) <= np.round(order(c, 0.9) * 50)) for c in x.T], axis=0)
    starts = [(np.array([order(c, 0.5) for c in x.T]), np.diag([((order(c, 0.75) - order(c, 0.25)) / 1.349) ** 2 for c in x.T]) + ridge)]
    starts += [(y.mean(0), np.cov(y.T, bias=True) + ridge) for y in (x, x[middle]) if len(y)]

    def distance(m, c):
        return (np.linalg.solve(np.linalg.cholesky(c), (x - m).T) ** 2).sum(0)

    def step(m, c):
        b = np.floor(s.bins * np.log(np.maximum(distance(m, c), 1e-4)))
        near = x[b <= np.sort(b)[int(np.ceil(s.share * len(b))) - 1]]
        return near.mean(0), np.cov(near.T, bias=True) + ridge

    for _ in range(s.trial):
        starts = [step(*p) for p in starts]
    best = min(starts, key=lambda p: np.linalg.slogdet(p[1])[1])
    for _ in range(s.steps - s.trial):
        best = step(*best)
    return distance(*best) / s.consistency


def vectors(got) -> np.ndarray:
    n = got.n_words
    return np.stack([np.log(1 + got.word_chars / n), np.log1p(100 * got.n_symbols / got.word_chars), np.log1p(20 * got.n_dup_lines / got.n_lines), np.log1p(20 * got.n_repeat_words / n), np.log1p(n)], 1)


def test_constants_follow_from_share_and_dimension():
    s = quality.Settings()
    assert s.cutoff == pytest.approx(15.0863, abs=1e-4) and s.consistency == pytest.approx(1.41, abs=5e-3)
    rng = np.random.default_rng(0)
    for share in (0.5, 0.75, 1.0 - 1e-12):
        d2 = (rng.standard_normal((400_000, 5)) ** 2).sum(1)
        near = d2 <= np.quantile(d2, share)
        # the scatter of the closest share, times the factor, is that of all
        assert quality.Settings(share=share).consistency * d2[near].mean() / 5 == pytest.approx(1, abs=0.01)


def test_small_groups_fall_back(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefg"), k)) for k in rng.integers(2, 9, 500)]
    text = lambda n: " ".join(rng.choice(words, n))
    rows = [(i, text(80 + i % 40), "en", "big") for i in range(150)] + [(200 + i, text(90), "en", f"small{i % 2}") for i in range(10)]
    rows += [(300 + i, text(90), "de", "x") for i in range(5)] + [(400 + i, text(90), None, f"y{i}") for i in range(60)] + [(500, text(90) + " ###" * 400, "*", None), (501, text(90) + " ###" * 400, "en", "small0")]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().sort_values("doc_id").reset_index(drop=True)
    x, s, ok = vectors(got).astype(float), quality.Settings(), ~got.base_failed.to_numpy()
    groups = {"big": got.source == "big", "en": got.lang == "en", "pool": got.lang.isna(), "all": got.doc_id >= 0}
    want = {k: np.full(len(got), np.nan) for k in groups}
    for k, g in groups.items():
        want[k][ok & g] = plain_mcd(x[ok & g], s)
    of = ["big" if a == "big" else "en" if b == "en" else "pool" if b is None or b != b else "all" for a, b in zip(got.source, got.lang)]
    for i, k in enumerate(of):
        if ok[i]:
            assert got.distance[i] == pytest.approx(want[k][i], rel=1e-6), (got.doc_id[i], k)
    assert not got.kept[got.doc_id >= 500].any() and got.kept[(got.doc_id < 500) & ok].mean() > 0.9


def test_distances_are_those_of_plain_mcd(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefg"), k)) for k in rng.integers(2, 9, 500)]
    rows = [(i, " ".join(rng.choice(words, 80 + i % 40)) + (" ### $$$" * 60 if i % 20 == 0 else ""), "en", "s") for i in range(200)]
    got = quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().sort_values("doc_id")
    s = quality.Settings()
    x = vectors(got)
    ok = ~got.base_failed.to_numpy()
    assert got.distance[ok] .to_numpy() == pytest.approx(plain_mcd(x[ok], s), rel=1e-6)
    assert not got.kept[got.doc_id % 20 == 0].any() and got.kept[(got.doc_id % 20 != 0) & ok].mean() > 0.98


def test_quality_cases(docs, empty, rows):
    got = quality.judged(docs)
    assert got.count() == len(rows)
    assert all(not r.kept for r in got.where("base_failed").collect())
    assert quality.judged(empty).count() == 0


def test_the_query_uses_contexts_beyond_four_bytes(spark, tmp_path):
    from verdance.llm import queries

    rng = np.random.default_rng(5)  # what follows "qqqqq" is told only by the byte before it
    texts = [" ".join(("aqqqqqb", "cqqqqqd")[i] for i in rng.integers(0, 2, 60)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    deep = {r.doc_id: r.score for r in queries.op3_lm_score(spark, str(tmp_path)).where("held_out").collect()}
    shallow = {r.doc_id: r.score for r in ctw.scored(spark.read.parquet(f"{tmp_path}/documents.parquet"), depth=4).where("held_out").collect()}
    assert deep and all(deep[d] > 0.7 * shallow[d] for d in deep)
