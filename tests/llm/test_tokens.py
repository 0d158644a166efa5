import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strandflow.llm import packing, token_store, word_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(PATH)
    return lambda text: np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


def test_words_encode_like_texts(ids_of, documents, odd_docs):
    texts = [r.text for r in odd_docs.select("text").collect()] + [r.text for r in documents.select("text").collect()]
    texts += ["hello <|endoftext|> world", "a<|startoftext|>b's<|endoftext|><|endoftext|>", "<|endoftext|>É́ <|ENDOFTEXT|> <|endoftext|"]
    texts += ["".join(map(chr, range(0x21, 0x250))), " ".join(map(chr, range(0x21, 0x600))), "\x1c\x85a b é ́x İI ΣΑΣ ﬁ"]
    raw = [t.encode() if t is not None else None for t in texts]
    ids, counts = word_tokens.encoder(PATH).encode(raw, 1)
    at = 0
    for text, n in zip(texts, counts):
        assert ids[at : at + n].tolist() == ids_of(text).tolist(), (text or "")[:60]
        at += n


def test_files_of_another_kind_are_encoded_whole(tmp_path):
    import json

    with open(PATH, encoding="utf-8") as f:
        file = json.load(f)
    file["normalizer"]["normalizers"].pop()
    other = tmp_path / "other.json"
    other.write_text(json.dumps(file))
    encoder = word_tokens.WordEncoder(str(other))
    texts = ["Hello World  it's", None, "", "ÉTÉ <|endoftext|>"]
    ids, counts = encoder.encode([t.encode() if t is not None else None for t in texts], 1)
    theirs = Tokenizer.from_file(str(other))
    assert not encoder.by_words and word_tokens.WordEncoder(PATH).by_words
    assert ids.tolist() == [i for t in texts for i in [*theirs.encode(t or "", add_special_tokens=False).ids, 1]] and counts.sum() == len(ids)


def test_perfect_hash():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(-(1 << 62), 1 << 62, n))
        assert sorted(token_store.PerfectHash.of(keys).slots(keys).tolist()) == list(range(len(keys)))


def check_store(spark, docs, ids_of, monkeypatch):
    rows = docs.collect()
    folder = token_store.write_store(docs, PATH)
    found = token_store.read_store(spark, folder).collect()
    assert len(found) == len(rows)
    found.sort(key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i or 0))
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens
    want = sorted((r.doc_id or -1, len(i), zlib.crc32(i.tobytes())) for r in rows for i in [ids_of(r.text)])
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in found) == want
    keys = [r.doc_id for r in rows if r.doc_id is not None]
    there = token_store.lookup(spark, folder, [*keys, 10**9, -5])
    assert set(there) == set(keys)
    with monkeypatch.context() as m:
        m.setattr(token_store, "FEW_KEYS", 0)
        whole = token_store.lookup(spark, folder, [*keys, 10**9, -5])
        assert {k: v.tolist() for k, v in whole.items()} == {k: v.tolist() for k, v in there.items()}
    texts = defaultdict(list)
    for r in rows:
        texts[r.doc_id].append(ids_of(r.text).tolist())
    assert all(there[k].tolist() in texts[k] for k in keys)


def test_store(spark, documents, ids_of, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_DOCS", 23)
    check_store(spark, documents, ids_of, monkeypatch)


def test_store_of_odd_rows(spark, odd_docs, no_docs, ids_of, monkeypatch):
    check_store(spark, odd_docs, ids_of, monkeypatch)
    assert token_store.read_store(spark, token_store.write_store(no_docs, PATH)).count() == 0


def check_pieces(docs, found, ids_of, tiers=packing.TIERS):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in found:
        by_sequence[r.sequence_id].append(r)
    want = sorted((r.doc_id or -1, len(i), tuple(i)) for r in docs for i in [ids_of(r.text)])
    for r in found:
        by_doc[r.doc_id or -1].append(r)
    assert sum(r.length for r in found) == sum(n for _, n, _ in want)
    for doc_id, n, ids in want:
        if sum(d == doc_id for d, _, _ in want) == 1:
            at = 0
            for r in sorted(by_doc[doc_id], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == n
                assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == n
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= pieces[0].tier and len({(r.tier, r.step_group) for r in pieces}) == 1
        padding += 0 if at == pieces[0].tier else max(tiers) - at
    return padding


def test_packing(spark, documents, ids_of):
    found = packing.pack(documents.repartition(3), PATH, step_tokens=8192).collect()
    assert check_pieces(documents.collect(), found, ids_of) <= 2048
    groups = defaultdict(set)
    for r in found:
        groups[r.tier, r.step_group].add(r.sequence_id)
    for tier in packing.TIERS:
        sizes = [len(v) for (t, g), v in sorted(groups.items()) if t == tier]
        assert all(n == 8192 // tier for n in sizes[:-1])


def test_packing_of_odd_rows(odd_docs, no_docs, ids_of):
    check_pieces(odd_docs.collect(), packing.pack(odd_docs, PATH).collect(), ids_of)
    assert packing.pack(no_docs, PATH).count() == 0


def test_packer_fills_windows_from_any_lengths():
    rng = np.random.default_rng(4)
    for lengths in ([1500] * 40, [2049] * 20, [1] * 3000, rng.integers(1, 5000, 300).tolist()):
        packer = packing.Packer(0)
        for i, n in enumerate(lengths):
            packer.add(i, np.arange(n, dtype=np.uint32))
        packer.pack()
        sizes = defaultdict(int)
        for _, _, n, _, _, s, _, tier, _ in packer.rows:
            sizes[s, tier] += n
        assert all(n == tier for (_, tier), n in sizes.items())
        assert sum(sizes.values()) + packer.tokens == sum(lengths) and packer.tokens < 2048
        packer.close()
        assert sum(r[2] for r in packer.rows) == sum(lengths)
