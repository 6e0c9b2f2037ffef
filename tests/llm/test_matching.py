from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm import brute
from verdance.llm import decontam, secret_scan, simhash, similar


def test_fingerprints_and_classes(docs, rows):
    got = Counter((r.doc_id, r.fingerprint & (1 << 64) - 1, r.component_id) for r in simhash.components(docs).collect())
    prints = [brute.simhash(t) for _, t in rows]
    of = brute.classes(prints, lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for (i, _), c in zip(rows, of):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    assert got == Counter((i, p, least.get(c)) for (i, _), p, c in zip(rows, prints, of))


@pytest.mark.parametrize("hot", [simhash.HOT, 3])
def test_links_connect_what_is_near(spark, hot):
    rng = np.random.default_rng(2)
    seeds = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    values = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(12):
            v = int(s)
            for b in rng.choice(64, rng.integers(1, 4), replace=False):
                v ^= 1 << int(b)
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fingerprint long")
    of = {r.node & (1 << 64) - 1: r["class"] for r in simhash.classes(simhash.links(df, hot=hot)).collect()}
    want = brute.classes(values, lambda a, b: (a ^ b).bit_count() <= 3)
    pairs = {(w, of.get(v, ("alone", v))) for v, w in zip(values, want)}
    assert len(pairs) == len(set(want)) == len({p[1] for p in pairs})


@settings(max_examples=50, deadline=None)
@given(st.sets(st.integers(0, (1 << 14) - 1), min_size=2, max_size=60))
def test_trie_walk(values):
    v = np.array(sorted(values), np.uint64) << np.uint64(50)
    got = simhash.trie_links(v, np.array([0]), 0)
    want = brute.classes([int(x) for x in v], lambda a, b: (a ^ b).bit_count() <= 3)
    assert len({*zip(got.tolist(), want)}) == len(set(want)) == len(set(got.tolist()))


@pytest.mark.parametrize("hot", [similar.HOT, 4])
def test_cut_buckets_lose_no_link(spark, hot, monkeypatch):
    """Chains of drifting copies, copies of one text and texts that are nearly but not similar, in shared buckets."""
    rng = np.random.default_rng(5)
    texts, own = [], [f"w{i}" for i in range(120)]
    for step in (1, 1, 2, 3, 4, 5):
        w = list(own)
        for _ in range(14):
            w = list(w)
            for i in rng.integers(0, len(w), step):
                w[i] = f"n{rng.integers(0, 10**6)}"
            texts.append(" ".join(w))
    for _ in range(25):
        w = list(own)
        w[int(rng.integers(0, 120))] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    sets = [{tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} for w in (brute.words(t) for t in texts)]
    prints = [brute.simhash(t) for t in texts]
    near = lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3 or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    of = brute.classes(list(range(len(texts))), near)
    cut = []
    against = similar._against_rest
    monkeypatch.setattr(similar, "_against_rest", lambda *a: cut.append(1) or against(*a))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(r.doc_id for r in similar.representatives(docs, hot).collect())
    assert got == sorted({of.index(c) for c in of})
    assert 1 < len(got) < len(texts) and bool(cut) == (hot == 4)


def test_no_classes(empty):
    assert simhash.components(empty).count() == 0


def test_secrets(docs, rows):
    got = secret_scan.scan(docs.select("doc_id", "text"))
    given_ = F.filter("spans", lambda x: x["kind"] < 3)
    counted = got.select("doc_id", *[secret_scan.count(i) for i in range(3)], F.sha2(secret_scan.listed(given_), 256))
    assert Counter(map(tuple, counted.collect())) == Counter((i, *brute.secrets(t)) for i, t in rows)
    assert any("github" in (r[0] or "") for r in got.select(secret_scan.listed(F.col("spans"))).collect())


def test_trigram_queries_are_necessary():
    for rule in secret_scan.RULES:
        q = secret_scan.trigram_query(rule.pattern)
        assert (q == secret_scan.ALWAYS) == (rule.kind == "hex")
    q = secret_scan.trigram_query("ab(cd|ce)f+")
    assert q == frozenset({frozenset({"abc", "bcd"}), frozenset({"abc", "bce"})}) or all("abc" in c for c in q)
    assert secret_scan.trigram_query("(foo)?bar") == frozenset({frozenset({"bar"})})


def test_masking(spark):
    df = spark.createDataFrame([(1, "a token = abcdefgh12345 b"), (2, "plain"), (3, None), (4, "token=" + "0" * 40)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in secret_scan.redacted(secret_scan.scan(df)).collect()}
    assert got == {1: "a [SECRET] b", 2: "plain", 3: None, 4: "[SECRET]"}


def test_no_secrets(empty):
    assert secret_scan.scan(empty).count() == 0


ITEM = "A train leaves the old Station at 3 o'clock and travels 120 miles at 60 miles per hour before Anna arrives with 4 apples for Bob."


def _found(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.kind for r in decontam.matches(docs, bench).collect()}, [r.doc_id for r in decontam.clean(docs, bench).collect()]


def test_verbatim_and_reparameterised(spark):
    other = ITEM.replace("120", "300").replace("60", "75").replace("Anna", "Maria").replace("Bob", "Tom")
    clean = "the of and it is in a train leaves the old house at night " * 5
    texts = ["x " + ITEM + " y", "Intro.\n" + ITEM.upper(), "text before. " + other + " text after", clean, None, "", "a"]
    got, kept = _found(spark, texts)
    assert got == {(0, 0): "reparameterised" if got[0, 0] != "verbatim" else "verbatim", (1, 0): "verbatim", (2, 0): "reparameterised"}
    assert got[0, 0] == "verbatim"
    assert sorted(kept) == [3, 4, 5, 6]


def test_inconsistent_slots_are_no_match(spark):
    item = " ".join(f"take {n} from the box and add {n} to the pile of {n} stones" for n in (5, 5, 5, 5))
    good = item.replace("5", "8")
    parts = iter(range(100, 200))
    bad = "".join(str(next(parts)) if c == "5" else c for c in item)
    got, _ = _found(spark, [good, bad], [item])
    assert got == {(0, 0): "reparameterised"}


def test_short_and_missing_items(spark):
    got, kept = _found(spark, ["say hello world now", "nothing"], ["hello world", None, ""])
    assert set(got) == {(0, 0)} and kept == [1]
    got, kept = _found(spark, ["a b c"], [])
    assert got == {} and kept == [0]


def test_blocks_of_the_benchmark_give_the_same(spark):
    items = [ITEM, "another question about the weight of 12 kg of sand in the yard"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([items[0], items[1], "none of it"])], "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(docs, bench, block_bytes=1).collect()} == {(0, 0), (1, 1)}
    assert [r.doc_id for r in decontam.clean(docs, bench, block_bytes=1).collect()] == [2]


def _in_text(text: str, item: str) -> bool:
    import numpy as np

    data = np.frombuffer(text.encode(), np.uint8)
    return bool(decontam.found_in(decontam.tokens(data, np.array([0, len(data)])), decontam.index([(1, item)])))


def test_templates_of_names_that_begin_sentences():
    form = "{} bought {} apples at the market. {} bought {} pears at the market. {} bought {} plums there. How many pieces of fruit did they buy in all?"
    item = form.format("Anna", 12, "Bob", 7, "Clara", 9)
    assert _in_text(form.format("Emil", 31, "Frida", 8, "Georg", 44), item)
    assert not _in_text(form.format("Emil", 31, "Frida", 8, "Georg", 44).replace("bought", "sold").replace("market", "fair"), item)


def test_hyphenated_number_words_are_numbers():
    form = "a farmer had {} sheep and gave {} of them to a neighbour who then had {} sheep in all"
    item = form.format("twenty-five", "ten", "thirty-one")
    assert _in_text(form.format("forty", "fifty-two", "ninety"), item)


def test_items_made_mostly_of_numbers():
    item = "add 3 17 29 4 88 51 get 192 7 6 5"
    assert _in_text("please add 5 11 23 8 71 64 get 182 9 2 1 now", item)
    assert not _in_text("5 11 23 8 71 64 182 9 2 1 14 15 16 18 19", item)
    assert not _in_text("please add 5 11 5 8 71 64 get 182 9 2 1 now", item)  # 3 and 29 are not one value


QUESTIONS = (
    "{0} bought {3} apples at the market on {6} Street and gave {4} of them to {1} before noon. How many apples has {0} left?",
    "{0} kaufte {3} kg Mehl und {4} kg Zucker für den Kuchen, den {1} am {5}. Mai backen will. Wie viel Mehl und Zucker hat {0}?",
    "A tank holds {3} litres; {4} litres flow out in {5} minutes. When is the tank that {0} filled empty?",
    "{0} et {1} ont {3} pommes. {2} en mange {4}. Combien de pommes restent à {0} et {1} ?",
    "add {3} {4} {5} to {3} and take {4} {5} from it then {5} {4} {3} again",
    "what is the capital of the country that lies north of the sea and south of the mountains",
)


def _filled(rng, form):
    names = ["Anna", "Bob", "Clara", "Émile", "Frida", "Georg", "Hanna", "Otto"]
    numbers = ["3", "12", "7.5", "forty-two", "nine", "1,000", "88", "5"]
    return form.format(*rng.choice(names, 3, replace=False), *rng.choice(numbers, 3, replace=False), rng.choice(names))


def test_matches_are_those_of_plain_comparison(spark, docs, rows):
    rng = np.random.default_rng(23)
    items = [(i % 7 if i % 5 else None, _filled(rng, QUESTIONS[i % len(QUESTIONS)])) for i in range(24)]
    items += [items[0], items[7], (3, None), (4, ""), (5, "hello world"), (None, "one two three"), (8, rows[9][1])]
    noise = "the old house and the sea are far from here so we walk".split()
    texts = []
    for i in range(60):
        words = _filled(rng, QUESTIONS[i % len(QUESTIONS)]).split(" ")
        if i % 4 == 0:
            words[int(rng.integers(0, len(words)))] = str(rng.choice(noise))
        if i % 3 == 0:
            words = [*rng.choice(noise, 30), *words, *rng.choice(noise, 30), *_filled(rng, QUESTIONS[(i + 1) % len(QUESTIONS)]).split(" ")]
        texts.append((None if i % 11 == 0 else i % 50, " ".join(words)))
    texts += [texts[3], texts[4], *rows, (70, "Hello world, and one two three"), (71, " ".join([items[1][1], "x"] * 300))]
    number_words, units = set(decontam.NUMBER_WORDS), set(decontam.UNITS)
    want, bad = Counter(), set()
    for doc_id, text in texts:
        for item_id, item in items:
            if (m := brute.contamination(text, item, number_words, units)) is not None:
                want[doc_id, item_id, *m] += 1
                bad.add(text)
    assert len({w[-1] for w in want}) == 2 and len(want) > 60
    corpus = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, item_id string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string").repartition(3)
    for more in ({}, {"block_bytes": 1, "filter_bits": 1 << 8}):
        assert Counter(map(tuple, decontam.matches(corpus, bench, **more).collect())) == want
        kept = Counter((r.doc_id, r.text) for r in decontam.clean(corpus, bench, **more).collect())
        assert kept == Counter((i, t) for i, t in texts if t not in bad)


def test_items_with_equal_and_null_ids_each_match(spark):
    items = [(7, ITEM), (7, "another question about the weight of 12 kg of sand in the yard"), (None, ITEM), (None, "what is the name of the river that flows through the old town")]
    docs = spark.createDataFrame([(1, items[0][1]), (2, items[3][1]), (3, " ".join(t for _, t in items))], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontam.BLOCK_BYTES, 1):
        got = Counter((r.doc_id, r.item_id) for r in decontam.matches(docs, bench, block_bytes=size).collect())
        assert got == Counter({(1, 7): 1, (1, None): 1, (2, None): 1, (3, 7): 2, (3, None): 2})
