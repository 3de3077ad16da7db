import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import packing, tokenfile, tokens
from tidemark.llm import sentencepieces as sp

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", "don't stop <|endoftext|>x 12 a1b2 ÀÉ×÷ x　y éa Σας \x1c\x85 b", "I'M 'll 's''s", "a" * 5000 + " " + "!?" * 300,
         "日本語 テスト🙂🙂 ok", "İstanbul ß ẞ", "½ ² ٣", "foo</w>bar </w>", "Licensed under CC. " * 400, " ", "the end"]


def reference():
    lib = Tokenizer.from_file(PATH)
    return [lib.encode(t or "", add_special_tokens=False).ids for t in TEXTS]


def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x"), (None, "no id", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(3)


def test_encoder_equals_the_library():
    got = {}
    for i, ids, bounds in tokens.encoded(pa.array(TEXTS), PATH):
        for k in range(len(bounds) - 1):
            got[i + k] = ids[bounds[k]:bounds[k + 1]].tolist()
    assert [got[i] for i in range(len(TEXTS))] == reference()


def test_encoder_starts_afresh_when_its_table_is_full(monkeypatch):
    monkeypatch.setattr(tokens, "_POOL", 50)
    encoder = tokens.Encoder(PATH)
    for text, ids in zip(TEXTS, reference(), strict=True):
        b = np.frombuffer((text or "").encode(), np.uint8)
        assert encoder.encode(b, np.array([0, len(b)]))[0].tolist() == ids


def test_token_files_give_the_ids_back(spark):
    files = tokenfile.write_token_files(docs(spark), PATH, 2)
    rows = tokenfile.read_token_files(files, ids=True).collect()
    expected = {i: ids + [2] for i, ids in enumerate(reference())}
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is not None:
            assert r.ids == expected[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    assert [r.doc_id for r in rows] == sorted([r.doc_id for r in rows], key=lambda i: (i is not None, i or 0))
    some = tokenfile.read_token_files(files, frozenset({2, 5}), ids=True).collect()
    assert {r.doc_id: r.ids for r in some} == {2: expected[2], 5: expected[5]}


def test_token_file_reads_only_what_is_asked_and_checks_it(tmp_path):
    store = pafs.LocalFileSystem()
    path = str(tmp_path / "x.bin")
    writer = tokenfile.Writer(store.open_output_stream(path), 2, frame_ids=10)
    content = [np.arange(n, dtype=np.uint32) for n in (3, 0, 25, 7, 1)]
    for i, ids in enumerate(content):
        writer.add(i, ids)
    writer.close()
    reader = tokenfile.Reader(store.open_input_file(path))
    assert [(i, d.tolist()) for i, d in reader.documents()] == [(i, c.tolist()) for i, c in enumerate(content)]
    data = bytearray(open(path, "rb").read())
    reader.table[1, 2] ^= 1
    with pytest.raises(ValueError):
        list(reader.documents(np.array([2])))
    assert [d.tolist() for _, d in reader.documents(np.array([0]))] == [[0, 1, 2]]
    open(path, "wb").write(data[:-3])
    with pytest.raises(ValueError):
        tokenfile.Reader(store.open_input_file(path))


def test_empty_tables(spark):
    none = docs(spark).where("false")
    assert tokenfile.read_token_files(tokenfile.write_token_files(none, PATH, 2)).count() == 0
    assert packing.pack(packing.cut(none, PATH, 64, 0), 64).count() == 0
    assert sp.encode(none, PIECES).count() == 0


def test_packing_is_whole_and_gapless(spark):
    rows = packing.pack(packing.cut(docs(spark), PATH, 64, 0, ids=True), 64).collect()
    expected = {i: ids + [0] for i, ids in enumerate(reference())}
    for i, ids in expected.items():
        own = sorted({(r.piece, r.start, r.length, tuple(r.ids)) for r in rows if r.doc_id == i})
        assert own == [(n, at, len(ids[at:at + 64]), tuple(ids[at:at + 64])) for n, at in enumerate(range(0, len(ids), 64))]
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= 64


@pytest.mark.parametrize("low, high", [(1, 100), (20, 55), (34, 70), (51, 100)])
def test_local_search_is_valid_and_no_worse_than_best_fit(low, high):
    lengths = np.random.default_rng(low).integers(low, high + 1, 700).tolist()
    bins = packing.Bins(lengths, 100)
    bins.best_fit_decreasing()
    before = sum(1 for b in bins.items if b)
    after = packing.pack_lengths(lengths, 100)
    assert sorted(i for b in after for i in b) == list(range(700)) and all(sum(lengths[i] for i in b) <= 100 for b in after)
    assert -(-sum(lengths) // 100) <= len(after) <= before


def best(model, text):
    """Brute force: the best sum of scores over all segmentations."""
    if not text:
        return 0.0
    found = []
    for n in range(1, len(text) + 1):
        if text[:n] in model.ids:
            found.append(model.ids[text[:n]][1] + best(model, text[n:]))
        elif n == 1:
            found.append(model.unknown + best(model, text[1:]))
    return max(found)


def test_pieces_are_the_best_segmentation():
    model = sp.Model.get(PIECES)
    names = {i: p for p, (i, _) in model.ids.items()}
    for text in ("▁hello", "▁thontion", "▁  x".replace(" ", "▁"), "▁naïve\n", "▁日本x", "▁aaaaaa"):
        ids = model.solve(text)
        score = sum(model.ids[names[i]][1] for i in ids if i in names)
        unknown = len([c for c in text if c not in model.ids])
        assert b"".join(model.text[i] for i in ids).decode() == text.replace("▁", " ")
        assert score + unknown * model.unknown == pytest.approx(best(model, text), rel=1e-12)


def test_chunks_equal_a_single_pass_and_texts_come_back(spark, monkeypatch):
    monkeypatch.setattr(sp, "CHUNK", 23)
    model = sp.Model.get(PIECES)
    for giant in (40, 10**9):
        encoded = sp.encode(docs(spark), PIECES, giant=giant)
        for r in encoded.collect():
            if r.doc_id is not None:
                text = TEXTS[r.doc_id]
                assert r.ids == (model.solve("▁" + text.replace(" ", "▁")) if text else [])
        back = sp.decode(encoded, PIECES).collect()
        assert len(back) == len(TEXTS) + 2 and all(r.text == (TEXTS[r.doc_id] or "") and r.piece == "x" for r in back if r.doc_id is not None)


def test_products_are_associative():
    m = np.random.default_rng(0).integers(-9, 0, (7, 3, 3)).astype(float)
    one = m[0]
    for k, p in enumerate(sp.products(m)):
        if k:
            one = (one[:, :, None] + m[k][None]).max(axis=1)
        assert (p == one).all()
