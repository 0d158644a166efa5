"""op13 against the libraries on whole texts and plain loops."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest

from strandflow.llm import token_alignment
from strandflow.llm.queries import op13_token_alignment
from strandflow.llm.token_alignment import Aligner, aligned, byte_of_letter, with_link_scores

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    return one, sentencepiece.SentencePieceProcessor(model_file=B)


@pytest.fixture(scope="module")
def aligner():
    return Aligner(A, B)


def plain_groups(text, libraries):
    """[(A ids, B ids), ...] by both libraries on the whole text."""
    if not text:
        return []
    one, two = libraries
    letters = byte_of_letter()
    a = one.encode(" " + text, add_special_tokens=False)
    ids = a.ids
    b = two.encode(text)
    a_bytes = [bytes(letters[c] for c in t) for t in a.tokens]
    b_bytes = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == b" " + text.encode():
        return []
    ends, out, total = [], [], 0
    for side in (a_bytes, b_bytes):
        total, own = 0, []
        for t in side:
            total += len(t)
            own.append(total)
        ends.append(own)
    common = sorted(set(ends[0]) & set(ends[1]))
    x = y = 0
    for cut in common:
        nx, ny = ends[0].index(cut, x) + 1, ends[1].index(cut, y) + 1
        out.append((ids[x:nx], b[y:ny]))
        x, y = nx, ny
    return out


def plain(rows, libraries):
    """The query's rows by plain loops."""
    groups = [plain_groups(text, libraries) for _, text in rows]
    held = Counter(pair for own in groups for pair in {(a, b) for x, y in own for a in x for b in y})
    most = {}
    for (a, _), n in held.items():
        most[a] = max(most.get(a, 0), n)
    out = []
    for (key, _), own in zip(rows, groups):
        links = [(a, b) for x, y in own for a in x for b in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in own)
        digest = hashlib.sha256(text.encode()).hexdigest() if own else ""
        out.append((key, sum(len(x) for x, _ in own), sum(len(y) for _, y in own), len(own), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), digest))
    return Counter(out)


ODD = ["", " ", "  ", "a", " a", "a  b", "x ▁y", "x▁y", "<s> </s> <unk> <|endoftext|> <0x41>", "\0a \x1c b", "日本語 の\nテキスト 🙂🙃 é é", "don't I'LL  we've \t tabs\r\n", "a" * 5000, "ab " * 3000, "=" * 777 + " " * 555, "ñ" * 301 + " x", "\x85\xa0 　 ​ x", "9" * 100 + " 12 345"]


def test_groups_of_odd_texts(aligner, libraries):
    found = aligner.part(ODD)
    for i, text in enumerate(ODD):
        groups = plain_groups(text, libraries)
        assert found["groups"][i] == ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups), text[:40]
        assert found["n_links"][i] == sum(len(x) * len(y) for x, y in groups)


def test_quick_words_equal_the_library(aligner, libraries):
    """Words of all settled characters, as they stand in texts and shuffled."""
    import random

    rng = random.Random(3)
    letters = [chr(c) for c in range(0x250) if not chr(c).isspace()]
    words = ["".join(rng.choices(letters, k=rng.randint(1, 12))) for _ in range(20_000)] + letters + ["'s", "x'll", "I'm", "don't", "<|endoftext|>", "a1b2", "\x1c", "x\u00a0y"]
    assert token_alignment.merged_by_id(A, aligner.a.pieces) is not None
    assert aligner.a.encode(words) == [e.ids for e in libraries[0].encode_batch([" " + w for w in words], add_special_tokens=False)]


def test_overlaps_are_all_pairs_of_tokens_that_share_bytes(aligner):
    import numpy as np

    a_ends, b_ends = np.array([2, 5, 6, 9, 10]), np.array([1, 5, 9, 10])
    found = token_alignment.overlaps(a_ends, np.array([0, 0, 0, 0, 1]), b_ends, np.array([0, 0, 0, 1]))
    assert list(map(tuple, found.to_numpy().tolist())) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 2), (4, 3)]


def test_large_groups_and_long_texts_part_by_part(aligner, libraries, monkeypatch):
    text = "ab cde  fghi " * 400 + "aaab" * 500 + " été" * 300
    expected = aligner.part([text])
    monkeypatch.setattr(token_alignment, "GROUP_LINKS", 1)
    for limit in (50, 1000):
        monkeypatch.setattr(token_alignment.text_parts, "__defaults__", (limit,))
        found = aligner.whole(text)
        for name in ("n_a", "n_b", "n_groups", "n_links", "code", "times"):
            assert found[name].tolist() == expected[name].tolist()
        assert found["groups"] == expected["groups"]
        assert aligner.whole("ab " * 100 + "x▁ y")["n_a"].tolist() == [0]
    assert expected["n_groups"][0] == len(plain_groups(text, libraries))


def test_forty_megabytes_in_bounded_memory(aligner):
    import resource

    text = "the cat sat on the mat and " * 1_500_000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = aligner.whole(text)
    assert found["n_a"][0] == 7 * 1_500_000 + 1
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 700_000


def test_query_equals_plain_loops(spark, libraries):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert Counter(map(tuple, op13_token_alignment(spark, "/root/testdata/sf0.001").collect())) == plain(rows, libraries)


@pytest.mark.parametrize("hot_pairs", [1 << 20, 50, 1])
def test_odd_rows_whatever_the_share_of_hot_pairs(spark, odd_docs, libraries, hot_pairs):
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    found = with_link_scores(aligned(odd_docs, A, B), token_alignment.piece_count(B), hot_pairs)
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    expected = Counter()
    for row, n in plain(rows, libraries).items():
        expected[row[:-1]] += n
    assert Counter(tuple(r[c] for c in ("doc_id", *names)) for r in found.collect()) == expected


def test_no_rows(spark, no_docs):
    assert with_link_scores(aligned(no_docs, A, B), token_alignment.piece_count(B)).collect() == []
