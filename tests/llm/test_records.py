import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import brute
from verdance.llm import base, packing, store, token_records, warc
from verdance.llm.tokenizing import encoder

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_encode_as_whole_texts(texts, name, keeps):
    odd = ["", " ", "a  b", " a", "a ", "<|endoftext|> x", "x\n y\n\n z \t q", "é é ΣΑΣ don't I'LL \x01 ", "it's%%% end.### ok,", "a_b. c_."]
    some = [t or "" for t in texts] + odd
    e = encoder(public_tokenizers.path(name), keeps)
    assert e.encode(some) == e.whole(some)
    assert e.encode(some) == e.whole(some)  # and once pieces are remembered


#: White space of many kinds, letters that grow or compose when made plain, marks, contractions.
ODD = [*" \n\t\r\x0b\x0c\x1c\x85\xa0\u1680\u180e\u2003\u2028\u202f\u3000\u200b", *"azAZ09éßŉıİſΣςж日²½ⅷ٣", *"\u0300\u0307\u0338\u0345", *"'’.,;:!?#$%&*)]}|(_-\"=\x01", "  ", "\n\n", "'s", "'RE", "İ.", "<|endoftext|>", "\U0001e94a", "\u1100", "\u1161"]


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
@settings(max_examples=150, deadline=None)
@given(some=st.lists(st.lists(st.sampled_from(ODD), max_size=14).map("".join), max_size=30))
def test_any_text_encodes_as_a_whole(name, keeps, some):
    e = encoder(public_tokenizers.path(name), keeps)
    assert e.encode(some) == e.whole(some)


@pytest.mark.parametrize(("name", "keeps"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_many_odd_texts_encode_as_wholes(name, keeps):
    rng = np.random.default_rng(17)
    some = ["Home \xa0 \xa0 News", "a \xa0 \xa0 \xa0 b", "end. \xa0 \xa0\n\nNext", "\x85 \xa0 \xa0\n-", "x İ?", "Diyarbakır İ."]
    some += ["".join(ODD[i] for i in rng.integers(0, len(ODD), n)) for n in rng.integers(1, 16, 100_000)]
    e = encoder(public_tokenizers.path(name), keeps)
    assert [t for t, a, b in zip(some, e.encode(some), e.whole(some)) if a != b] == []


def test_records_round_trip(spark, docs, rows):
    uri = base.scratch(spark, "t-shards")
    manifest = token_records.write(docs, public_tokenizers.path("byte_bpe_50k.json"), uri, shard_bytes=2_000)
    got = [tuple(r) for r in token_records.read(manifest).orderBy("start").collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    ids = brute.encoded([t for _, t in order], "byte_bpe_50k.json")
    assert got == [(i, int(s), len(x), brute.crc(x)) for (i, _), s, x in zip(order, np.cumsum([0, *map(len, ids)]), ids)]
    shards = manifest.collect()
    assert len(shards) > 4
    s = shards[0]
    records = list(token_records.read_shard(s.uri))
    again = list(token_records.read_records(s.uri, np.arange(len(records))[::-1]))
    assert [r.ids.tolist() for r in again] == [r.ids.tolist() for r in records[::-1]]
    plan = token_records.shuffled(manifest, 5).collect()
    assert len(plan) == len(rows) and len(set(plan)) == len(rows)


def test_damage_is_found(spark, docs):
    uri = base.scratch(spark, "t-damage")
    s = token_records.write(docs, public_tokenizers.path("byte_bpe_50k.json"), uri).first()
    data = bytearray(store.get(s.uri))
    for at in (20, 40, len(data) - 2):
        bad = bytearray(data)
        bad[at] ^= 1
        store.put(uri + "/bad.bin", bytes(bad))
        with pytest.raises(ValueError):
            list(token_records.read_shard(uri + "/bad.bin"))


def test_no_records(spark, empty):
    manifest = token_records.write(empty, public_tokenizers.path("byte_bpe_50k.json"), base.scratch(spark, "t-none"))
    assert token_records.read(manifest).count() == 0


def test_packing_is_gapless_and_complete(docs, rows):
    found = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    ids = brute.encoded([t for _, t in rows], "word_bpe_49k.json")
    want = Counter((i, k // 2048, k, len(x[k:k + 2048]), brute.crc(x[k:k + 2048])) for (i, _), x in zip(rows, ids) for k in range(0, len(x), 2048))
    got = Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in found.itertuples())
    assert got == want
    for _, g in found.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == np.cumsum([0, *g.length])[:-1].tolist() and g.length.sum() <= 2048
    counts = Counter(len(x[k:k + 2048]) for x in ids for k in range(0, len(x), 2048))
    assert found.sequence_id.nunique() <= packing.lower_bound(counts) + 1


def test_salts_change_no_places_but_ranks(docs):
    found = base.stored(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")), "t-pieces")
    one, many = (packing.pack(found, per_salt=n).toPandas() for n in (1 << 20, 3))
    for f in (one, many):
        assert not f.duplicated(["sequence_id", "offset"]).any() and len(f) == found.count()
    assert one.sequence_id.nunique() == many.sequence_id.nunique()


def test_nothing_to_pack(empty):
    assert packing.packed(empty, public_tokenizers.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_plans_use_each_piece_once(counts):
    patterns = packing.plan(counts, 40)
    used = Counter()
    for p, n in patterns:
        assert sum(p) <= 40 and n > 0
        for x in p:
            used[x] += n
    assert used == Counter(counts)
    where = packing.slots(patterns, counts)
    assert len(where["begin"]) == sum(len(p) for p, _ in patterns)
    assert sum(n for _, n in patterns) <= 2 * packing.lower_bound(counts, 40) + 1


def test_exact_complements_fill_windows():
    assert set(packing.plan({30: 2, 10: 1, 4: 1, 6: 1}, 40)) == {((30, 10), 1), ((30, 6, 4), 1)}
    assert packing.plan({25: 1, 5: 3}, 40) == [((25, 5, 5, 5), 1)]


PAGES = [(5, "http://a/x y", "p" * 200), (3, None, "p" * 200), (9, "u\r\nv", "p" * 200), (1, "b", "short"), (2, "b", "short"), (7, "c", None), (8, "c", ""), (4, "d", "é" * 60), (6, "d", "é" * 60), (10, "e", "x" * 100), (11, "e", "x" * 100), (12, "f", "x" * 99), (13, "f", "x" * 99)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, digest int").repartition(3)
    one, two = (warc.write(pages, base.scratch(spark, f"t-warc{i}"), roll_bytes=600) for i in range(2))
    assert sorted(r.sha256 for r in one.collect()) == sorted(r.sha256 for r in two.collect())
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(one).collect()}
    assert got == brute.revisits([(i, h) for i, _, h in PAGES])
    assert one.count() > 2 and not store.files(one.first().uri.rsplit("/", 1)[0], ".tmp")


def test_archive_cases(spark):
    schema = "page_id long, url string, html string"
    rows = [(1, "a", "y" * 150), (1, "a", "y" * 150), (None, "b", "y" * 150), (None, None, "z" * 150)]
    got = warc.read(warc.write(spark.createDataFrame(rows, schema), base.scratch(spark, "t-cases"))).collect()
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got) == Counter({(1, "response", None): 2, (None, "revisit", 1): 1, (None, "response", None): 1})
    assert warc.read(warc.write(spark.createDataFrame([], schema), base.scratch(spark, "t-empty"))).count() == 0


def test_archives_do_not_depend_on_partitions(spark):
    page = "concat(repeat(concat('line ', id % 700, ' of a page '), 1 + cast(id % 97 as int)), if(id % 5 = 0, '', cast(id as string)))"
    pages = spark.range(20_000).selectExpr("if(id % 50 = 1, null, id) as page_id", "concat('http://h/', id) as url", f"{page} as html")
    found, before = [], base.parts(spark)
    try:
        for n, rows in ((8, pages.repartition(3)), (3, pages.repartition(7).orderBy("html")), (8, pages.repartition(3))):
            spark.conf.set("spark.sql.shuffle.partitions", str(n))
            manifest = warc.write(rows, base.scratch(spark, "t-same"), shard_bytes=1 << 20, roll_bytes=40_000)
            found.append([(r.shard, r.roll, r.records, r.sha256) for r in manifest.orderBy("shard", "roll").collect()])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", str(before))
    assert found[0] == found[1] == found[2]
    assert sum(r[2] for r in found[0]) == 20_000 and len({r[0] for r in found[0]}) > 10 and max(r[1] for r in found[0]) > 0
    ids = sorted(warc.read(manifest).select("page_id").toPandas().page_id.dropna().astype(int))
    assert ids == [i for i in range(20_000) if i % 50 != 1]


def test_long_pages(spark):
    pages = spark.createDataFrame([(i, "u", str(i) + "é" * 3_000_000) for i in range(3)] + [(9, "u", "2" + "é" * 3_000_000)], "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.refers_to) for r in warc.read(warc.write(pages, base.scratch(spark, "t-long"))).collect())
    assert got == [(0, 6_000_001, None), (1, 6_000_001, None), (2, 6_000_001, None), (9, 6_000_001, 2)]


def test_frames_are_masked():
    assert token_records.masked(b"abc") != zlib.crc32(b"abc")
    assert token_records.frame(b"abc")[:8] == (3).to_bytes(8, "little")
