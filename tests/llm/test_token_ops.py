"""Tokens: the cached encoder, records, packing, edits, shards, against the library and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vitrine.llm import bpe, crc32c, edit_counts, packing, records, shards
from vitrine.llm.storage import new_dir
from vitrine.llm.words import find_words, text_buffers

ODD = [None, "", " ", "\n\t", "don't x.'s ab'll ...", "<|endoftext|> a<|startoftext|>B", "İI ǅ Σς ß ΑΣ.", "é ≮ a̧,", "a b c", "日本語テキスト 12ab34", "🙂🙂x", "A" * 5000, "a," * 2000]


@pytest.fixture(scope="module")
def library():
    return bpe.WordEncoder(bpe.default_path()).tokenizer


def ids(library, text):
    return library.encode(text or "", add_special_tokens=False).ids + [2]


def encoded(texts):
    out = []
    for _, flat, bounds in bpe.encoder(bpe.default_path()).encode(*text_buffers(pa.array(texts, pa.string()))):
        out += [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return out


def test_encoder_on_odd_texts(library):
    assert encoded(ODD) == [ids(library, t) for t in ODD]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aAbB éÉßñ.,'!<|>-_09 \n\tİΣ̸́"), st.characters(codec="utf-8")), max_size=30), max_size=4))
def test_encoder_is_the_library(texts):
    tokenizer = bpe.encoder(bpe.default_path()).tokenizer
    assert encoded(texts) == [ids(tokenizer, t) for t in texts]


def test_a_full_cache_starts_anew():
    small = bpe.WordEncoder(bpe.default_path(), room=3)
    for text in ("one two three four", "five one", "six seven"):
        got = [x.tolist() for _, x, _ in small.encode(*text_buffers(pa.array([text])))][0]
        assert got == ids(small.tokenizer, text)


def test_a_full_cache_keeps_words_met_again():
    small = bpe.WordEncoder(bpe.default_path(), room=20)
    made = []
    merge = small.merge
    small.merge = lambda word: made.append(word) or merge(word)
    for k in range(12):  # four words that come again, four new ones
        text = "red green blue größe " + " ".join("new" + "abcdefghijkl"[k] * (j + 1) for j in range(4))
        got = [x.tolist() for _, x, _ in small.encode(*text_buffers(pa.array([text])))][0]
        assert got == ids(small.tokenizer, text) and len(small.row) <= 20
    assert made.count("red") == 1 and len(made) == 4 + 4 * 12


def test_words_are_bytes_split():
    texts = ["a b", "", "\x0b\x0c x y \n", None, "z"]
    w = find_words(*text_buffers(pa.array(texts)))
    got = [[] for _ in texts]
    for d, c in zip(w.doc, w.codes, strict=True):
        got[d].append(w.vocab[int(c)].as_py())
    assert got == [(t or "").encode().split() for t in texts]


def test_crc32c():
    assert crc32c.crc32c(np.frombuffer(b"123456789", np.uint8), np.array([0]), np.array([9]))[0] == 0xE3069283

    def slow(b):
        c = 0xFFFFFFFF
        for x in b:
            c ^= x
            for _ in range(8):
                c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
        return c ^ 0xFFFFFFFF

    r = random.Random(3)
    parts = [r.randbytes(n) for n in (0, 1, 255, 256, 257, 1000, 70000)]
    length = np.array([len(p) for p in parts])
    got = crc32c.crc32c(np.frombuffer(b"".join(parts), np.uint8), np.cumsum(length) - length, length)
    assert got.tolist() == [slow(p) for p in parts]


def test_damaged_records_are_found():
    data, at = records.framed([b"one", b"", b"three"])
    assert records.parsed(data, at) == [b"one", b"", b"three"]
    for k in (0, 9, 13, len(data) - 1):
        bad = bytearray(data)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.parsed(bytes(bad), at)


SCHEMA = "doc_id long, text string, source string, ids string, start string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, "s", "x", "y") for d, t in rows], SCHEMA).repartition(3)


def test_records_round_trip(spark, library):
    rows = [(7, "b c"), (7, "a"), (None, "null id"), (-3, None), (10**12, "long " * 3000), (8, ""), (8, "")]
    folder = new_dir(spark, "records")
    manifest = records.write_records(table(spark, rows), folder)
    found = records.read_records(manifest, folder).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1e9, r.n_tokens, r.ids_crc32) for r in found) == sorted(
        (d if d is not None else -1e9, len(i := ids(library, t)), zlib.crc32(np.array(i, "<u4").tobytes())) for d, t in rows
    )
    got = [(r.doc_id, r.start, r.n_tokens) for r in sorted(records.write_and_read(table(spark, rows)).collect(), key=lambda r: r.start)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [d for d, _, _ in got] == [d for d, _ in order]
    n = [k for _, _, k in got]  # rows of one doc_id come in any order
    assert sorted((str(d), k) for d, _, k in got) == sorted((str(d), len(ids(library, t))) for d, t in rows)
    assert [s for _, s, _ in got] == (np.cumsum(n) - n).tolist()
    part = manifest.where("n_docs > 0").first()
    index = np.fromfile(f"{folder.removeprefix('file://')}/{part['index']}", records.ENTRY)
    for e in index[::-1]:  # a shuffled read
        doc, own = records.read_at(folder, part["records"], int(e["at"]))
        assert len(own) == e["n_ids"] and (doc == e["doc_id"] or e["flags"] & 1)


def test_empty_tables(spark):
    empty = table(spark, [])
    assert records.write_and_read(empty).count() == 0
    assert packing.pack_documents(empty).count() == 0
    assert shards.shard_documents(empty).count() == 0
    assert edit_counts.count_after_edits(edit_counts.revised(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=60))
def test_packing_holds_the_capacity(sizes):
    window = packing.pack(np.array(sizes, np.int64), 100)
    sums = np.bincount(window, weights=sizes) if sizes else np.zeros(0)
    assert (sums <= 100).all()
    if len(sizes) > 10:
        assert len(sums) <= -(-sum(sizes) // 100) * 2


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 900, 500)
    sums = np.bincount(packing.differencing(sizes, 40), weights=sizes)
    assert sums.max() - sums.min() <= 40 and sums.sum() == sizes.sum()
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_a_million_short_pieces_take_little(spark):
    import tracemalloc

    sizes = np.ones(packing.GROUP_PIECES, np.int64)
    tracemalloc.start()
    window = packing.pack(sizes)
    assert np.bincount(window).max() <= 4096 and window.max() + 1 == 16 and tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()
    pieces = spark.range(1 << 20).selectExpr("id as doc_id", "1L as length", "'n' as _piece", "'m' as _group", "7 as offset")
    out = packing.assign(pieces)
    assert sorted(out.columns) == ["_group", "_piece", "doc_id", "length", "offset", "sequence_id"]
    full = out.groupBy("sequence_id").agg({"length": "sum", "offset": "max"}).toPandas()
    assert full["sum(length)"].sum() == 1 << 20 and full["sum(length)"].max() <= 4096 and (full["max(offset)"] == full["sum(length)"] - 1).all()


def test_pieces_cover_every_document(spark, library):
    r = random.Random(5)
    rows = [(k, " ".join(r.choice(["ab", "cde", "x1", "señor"]) for _ in range(r.choice([0, 3, 40, 900, 9000])))) for k in range(60)] + [(3, "again"), (None, None)]
    out = packing.pack_documents(table(spark, rows)).toPandas()
    assert out.length.sum() == sum(len(ids(library, t)) for _, t in rows)
    for _, own in out.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own.offset == own.length.cumsum() - own.length).all() and own.length.sum() <= 4096
    unique = {d: ids(library, t) for d, t in rows if d != 3}
    for p in out[out.doc_id.isin([d for d in unique if d is not None])].itertuples():
        assert zlib.crc32(np.array(unique[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32


@settings(max_examples=120, deadline=None)
@given(st.text("ab ,.\né", max_size=400), st.lists(st.tuples(st.integers(0, 450), st.integers(0, 30), st.sampled_from(["", " ", "zz", " q ", "a\nb", "é."])), max_size=6))
def test_tree_counts_like_a_full_encoding(text, edits):
    full = bpe.encoder(bpe.default_path()).tokenizer
    (_, tree), *_ = edit_counts.trees(*text_buffers(pa.array([text])), bpe.default_path())
    now = text.encode()
    for begin, n, put in edits:
        begin = edit_counts._edge(tree, begin)
        end = edit_counts._edge(tree, begin + n)
        tree.edit(begin, end, put.encode())
        now = now[:begin] + put.encode() + now[end:]
        assert tree.text() == now and tree.n_bytes == len(now)
        assert tree.n_tokens == len(full.encode(now.decode(), add_special_tokens=False).ids)


def test_edits_touch_little(spark, library):
    rows = [(1, "some words of a long text " * 800), (2, None), (2, None), (None, "x"), (3, "short é text")]
    revised = edit_counts.revised(table(spark, rows))
    out = {r.doc_id: r for r in edit_counts.count_after_edits(revised).collect()}
    for r in revised.collect():  # the edits by hand, and the whole text encoded
        now = (r.text or "").encode()
        for e in r.edits:
            begin, end = (min(x, len(now)) for x in (e.begin, e.end))
            while 0 < begin < len(now) and now[begin] & 0xC0 == 0x80:
                begin -= 1
            while 0 < end < len(now) and now[end] & 0xC0 == 0x80:
                end -= 1
            now = now[:begin] + e.put.encode() + now[end:]
        assert out[r.doc_id].n_tokens_after == len(ids(library, now.decode())) - 1 and out[r.doc_id].n_bytes_after == len(now)
    assert out[1].reencoded_bytes < out[1].n_bytes_after / 20 and out[1].n_edits == 3
    assert out[1].n_tokens_before == len(ids(library, rows[0][1])) - 1
    assert out[2].n_tokens_before == 0


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.sampled_from("the ing tion a e str xqz an er ou Th zz hello 's é 5 -- <|endoftext|>".split() + [" "]), min_size=3, max_size=60),
    st.lists(st.tuples(st.integers(0, 200), st.sampled_from([0, 0, 1, 2, 5, 30]), st.sampled_from(["", "a", "the", "xqz", "'s", "'", " ", "é", "Q", "9", "\u0301", "re", "tionth" * 4])), max_size=6),
    st.sampled_from([4, 16, 64]),
)
def test_runs_of_letters_are_cut_between_tokens(parts, edits, size):
    """Leaves within words, however small, count as the whole text does."""
    full, text = bpe.encoder(bpe.default_path()).tokenizer, "".join(parts)
    old, edit_counts.LEAF_BYTES = edit_counts.LEAF_BYTES, size
    try:
        (_, tree), *_ = edit_counts.trees(*text_buffers(pa.array([text])), bpe.default_path())
    finally:
        edit_counts.LEAF_BYTES = old
    now = text.encode()
    assert tree.n_tokens == len(full.encode(text, add_special_tokens=False).ids)
    for begin, n, put in edits:
        begin = edit_counts._edge(tree, begin)
        end = edit_counts._edge(tree, begin + n)
        tree.edit(begin, end, put.encode())
        now = now[:begin] + put.encode() + now[end:]
        assert tree.text() == now and tree.n_tokens == len(full.encode(now.decode(), add_special_tokens=False).ids)


def test_long_runs_of_one_letter():
    """Where every token shifts, no more than a few times the run is encoded."""
    text = "a" * 200_000
    (_, tree), *_ = edit_counts.trees(*text_buffers(pa.array([text])), bpe.default_path())
    tree.edit(100_000, 100_003, b"x")
    assert tree.encoded < 6 * len(text) and tree.n_tokens == len(bpe.encoder(bpe.default_path()).tokenizer.encode(tree.text().decode(), add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["a," * 300_000, "12" * 300_000, "ab1" * 200_000, "word;" * 120_000, "abc" * 200_000, "".join(random.Random(1).choices("etaoinshrdlu", k=600_000))])
def test_edits_without_white_space_touch_little(text):
    (_, tree), *_ = edit_counts.trees(*text_buffers(pa.array([text])), bpe.default_path())
    for edit in ((300_000, 300_000, b" inserted "), (200_000, 200_024, b""), (100_000, 100_003, b"x"), (10**9, 10**9, b"ending")):
        tree.edit(*edit)
    assert tree.encoded < 24_000 and tree.n_tokens == len(bpe.encoder(bpe.default_path()).tokenizer.encode(tree.text().decode(), add_special_tokens=False).ids)


@settings(max_examples=200, deadline=None)
@given(st.text("ab19,.'<|>\né ", max_size=120), st.lists(st.tuples(st.integers(0, 130), st.integers(0, 12), st.sampled_from(["", "<|endof", "text|>", "<|endoftext|>", "'", "s", "7", "<", "|>", "é"])), max_size=6))
def test_tree_with_special_tokens(text, edits):
    full = bpe.encoder(bpe.default_path()).tokenizer
    text = text + "<|endoftext|>" * (len(text) % 3 == 0) + text
    (_, tree), *_ = edit_counts.trees(*text_buffers(pa.array([text])), bpe.default_path())
    for begin, n, put in edits:
        begin = edit_counts._edge(tree, begin)
        tree.edit(begin, edit_counts._edge(tree, begin + n), put.encode())
        assert tree.n_tokens == len(full.encode(tree.text().decode(), add_special_tokens=False).ids)


def test_another_tokenizer_file_encodes_whole_texts(tmp_path):
    """A file that keeps case and white space: its ids are the library's, and edits are counted from whole texts."""
    import json

    from tokenizers import Tokenizer

    spec = json.loads(bpe.encoder(bpe.default_path()).tokenizer.to_str())
    spec["normalizer"], spec["pre_tokenizer"] = None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    path = f"{tmp_path}/other.json"
    with open(path, "w") as f:
        json.dump(spec, f)
    other, own = Tokenizer.from_file(path), bpe.WordEncoder(path)
    assert not own.by_words
    texts = ["Aa bB  c", "", None, "x,1 2 3", "Aa bB  c"]
    got = []
    for _, flat, bounds in own.encode(*text_buffers(pa.array(texts))):
        got += [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert got == [other.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    (_, tree), *_ = edit_counts.trees(*text_buffers(pa.array(["Some Words, 12 of a  text"])), path)
    tree.edit(5, 6, b" W")
    assert tree.n_tokens == len(other.encode(tree.text().decode(), add_special_tokens=False).ids)


def test_hot_and_clashing_rows(spark):
    rows = [(1, "same")] * 400 + [(k, "t") for k in range(50)]
    df = spark.createDataFrame([(d, t, "a", 1, 2, 3, 4) for d, t in rows], "doc_id long, text string, _part string, _inner int, _place int, shard int, row_number int")
    out = shards.shard_rows(df, ["doc_id"])
    assert out.columns == ["doc_id", "text", "_part", "_inner", "_place", "row_number", "shard", "slot"]
    got = out.collect()
    assert sorted(r.row_number for r in got) == list(range(450)) and {r._part for r in got} == {"a"}
    assert max(np.bincount([r.shard for r in got])) - min(np.bincount([r.shard for r in got])) <= 1
    order = sorted(got, key=lambda r: r.row_number)
    assert [r.doc_id for r in order] == sorted(d for d, _ in rows)
    folder = new_dir(spark, "records")
    manifest = records.write_records(df.repartition(4), folder).collect()
    assert sum(m.n_docs for m in manifest) == 450 and max(m.n_docs for m in manifest) < 300  # one doc_id does not fill a shard


@pytest.mark.parametrize("n", [1, 2, 3, 7, 8, 9, 64, 1000, 4097])
def test_permutation(n):
    place = shards.permute(np.arange(n), n)
    assert sorted(place.tolist()) == list(range(n))
    assert (shards.permute(place, n, back=True) == np.arange(n)).all()


def test_shards_are_even_and_repeat(spark):
    rows = [(k // 2, "same" if k % 3 else None) for k in range(101)] + [(None, "é")]
    one, two = (sorted(map(tuple, shards.shard_documents(table(spark, rows)).collect()), key=str) for _ in range(2))
    assert one == two and len(one) == 102
    count = np.bincount([r[4] for r in one], minlength=8)
    assert count.max() - count.min() <= 1
    for s in range(8):
        assert sorted(r[5] for r in one if r[4] == s) == list(range(count[s]))
    assert {r[1:3] for r in one if r[0] is None} == {(3, zlib.crc32("é".encode()))} and (1, 0) in {r[1:3] for r in one}
