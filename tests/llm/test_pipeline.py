import pytest

from tests.llm import brute
from verdance.llm import decontam, quality, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory, docs):
    from tests.llm.conftest import prose

    import numpy as np

    rng = np.random.default_rng(8)
    item = "What is the total weight of the stones that the old mason carried up the hill before noon on the second day of his work"
    rows = [(i, prose(rng, 120) + (f"\n{item}." if i % 30 == 0 else "") + (" token = abcdef0123456789abcdef" if i % 25 == 0 else ""), "en", f"s{i % 2}", 0) for i in range(200)]
    rows += [(200 + i, rows[7][1], "en", "s1", 0) for i in range(5)] + [(300 + i, "### $$$ word " * 60 + str(i), "en", "s0", 0) for i in range(8)] + [(400, None, None, None, None), (7, rows[7][1], "en", "s1", 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_each_stage_does_what_its_operator_says(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    one = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept and not kept & {*range(300, 308), 400}
    two = corpus_pipeline.near_duplicates(spark, one, sf_dir)
    rows = one.select("doc_id", "text").collect()
    of = brute.classes([brute.simhash(r.text) for r in rows], lambda a, b: (a ^ b).bit_count() <= 3)
    assert sorted(r.doc_id for r in two.collect()) == sorted({c: min(r.doc_id for r, k in zip(rows, of) if k == c) for c in of}.values())
    three = corpus_pipeline.decontaminated(spark, two, sf_dir)
    bad = {r.doc_id for r in decontam.matches(two, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert bad and {r.doc_id for r in three.collect()} == {r.doc_id for r in two.collect()} - bad
    four = corpus_pipeline.without_secrets(spark, three, sf_dir)
    assert four.columns == columns and four.count() == three.count()
    texts = {r.doc_id: r for r in four.collect()}
    assert "[SECRET]" in texts[25].text and "abcdef0123" not in texts[25].text and texts[25].n_chars == len(texts[25].text)
    five = corpus_pipeline.packed(spark, four, sf_dir)
    assert five.select("doc_id").distinct().count() == four.count()


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100


def _plain(rows: list, items: list) -> dict[str, list]:
    """What stays after each stage, by plain comparison."""
    import numpy as np

    from tests.llm.test_scoring import plain_mcd

    s, out = quality.Settings(), {}
    stats = [brute.base_statistics(r.text) for r in rows]
    lines = [sum(brute.WORD.search(x) is not None for x in (r.text or "").split("\n")) for r in rows]
    x = np.array([[np.log(1 + c / max(n, 1)), np.log1p(100 * sy / max(c, 1)), np.log1p(20 * du / max(li, 1)), np.log1p(20 * re_ / max(n, 1)), np.log1p(n)] for (n, c, sy, du, re_, _), li in zip(stats, lines)])
    good = []
    for source in sorted({r.source for r in rows if r.source}):
        mine = [i for i, r in enumerate(rows) if r.source == source and not stats[i][-1]]
        assert len(mine) >= s.least
        good += [i for i, d in zip(mine, plain_mcd(x[mine], s)) if d <= s.cutoff]
    kept = out["quality_rules"] = [rows[i] for i in sorted(good)]
    prints = [brute.simhash(r.text) for r in kept]
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (brute.words(r.text.lower()) for r in kept)]
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    first = {}
    for r, c in zip(kept, brute.classes(list(range(len(kept))), near)):
        first[c] = min(first.get(c, r), r, key=lambda r: r.doc_id)
    kept = out["simhash_near_dedup"] = list(first.values())
    words = (set(decontam.NUMBER_WORDS), set(decontam.UNITS))
    kept = out["benchmark_decontamination"] = [r for r in kept if not any(brute.contamination(r.text, t, *words) for t in items)]
    masked = []
    for r in kept:
        hidden = set()
        for pattern, good_ in brute.SECRETS.values():
            hidden |= {i for m in pattern.finditer(r.text) if good_(m) for i in range(m.start(), m.end())}
        masked.append((r.doc_id, "".join("\0" if i in hidden and i - 1 not in hidden else "" if i in hidden else c for i, c in enumerate(r.text)).replace("\0", "[SECRET]")))
    out["secret_scans"] = masked
    out["best_fit_packing"] = [(d, k // 2048, k, len(e[k:k + 2048]), brute.crc(e[k:k + 2048])) for (d, _), e in zip(masked, brute.encoded([t for _, t in masked], "word_bpe_49k.json")) for k in range(0, len(e), 2048)]
    return out


def test_the_whole_pipeline_equals_a_plain_one(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = _plain(docs.collect(), items)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name == "best_fit_packing":
            got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in docs.collect()]
            places = sorted((r.sequence_id, r.offset, r.length) for r in docs.collect())
            assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip(places, places[1:]))
            assert sorted(got) == sorted(want[name])
        else:
            docs = spark.createDataFrame(docs.collect(), docs.schema)
            rows = [tuple(r)[:2] for r in docs.collect()]
            assert sorted(rows) == sorted(tuple(r)[:2] for r in want[name]), name
    run = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(run) == sorted(want["best_fit_packing"])


def test_empty_corpus(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("false").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_are_listed():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    assert simhash.BUDGET == 3


def test_columns_with_our_names_are_kept(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    odd = {c: F.lit(i) for i, c in enumerate(("text_key", "t", "its_id", "place", "may_assign", "block", "kept", "g1", "fingerprint", "spans", "a.b", "__spans"))}
    docs = docs.withColumns(odd)
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.near_duplicates, corpus_pipeline.decontaminated, corpus_pipeline.without_secrets):
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() > 0
        assert [tuple(r) for r in out.select(*[f"`{c}`" for c in odd]).distinct().collect()] == [tuple(range(len(odd)))]


def test_one_row_of_each_class_stays_whatever_its_id(spark):
    from tests.llm.conftest import prose

    import numpy as np

    rng = np.random.default_rng(3)
    a, b, c, d, e, f = (prose(rng, 150) for _ in range(6))
    # nulls with different texts; id 5 on a text of its own and on a copy of 3; a null copy of 8
    rows = [(None, a), (None, b), (None, b), (5, c), (5, d), (3, d), (8, e), (None, e), (9, f), (9, f)]
    for flip in (False, True):  # whichever of 5's texts sorts first
        mine = [(i, {c: d, d: c}.get(t, t) if flip else t) for i, t in rows]
        docs = spark.createDataFrame(mine, "doc_id long, text string")
        got = sorted((r.doc_id or -1, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
        x, y = (d, c) if flip else (c, d)
        assert got == sorted([(-1, a), (-1, b), (5, x), (3, y), (8, e), (9, f)])


def test_copies_beyond_three_bits_are_found(spark):
    from tests.llm.conftest import prose

    import numpy as np

    rng = np.random.default_rng(4)
    rows, sets = [], []
    for i in range(40):
        words = prose(rng, 120).split()
        for j in range(3):
            mine = list(words)
            for at in rng.choice(120, j, replace=False):
                mine[at] = f"edit{i}x{j}"
            rows.append((3 * i + j, " ".join(mine)))
            sets.append({tuple(mine[k:k + 5]) for k in range(len(mine) - 4)})
    prints = [brute.simhash(t) for _, t in rows]
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    want = set(brute.classes(list(range(len(rows))), near))
    bits_only = set(brute.classes(prints, lambda a, b: (a ^ b).bit_count() <= 3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.count() == len(want) < len(bits_only)
