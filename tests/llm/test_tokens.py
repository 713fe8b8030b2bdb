"""Encoders, counts and token files against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from govspark.llm import byte_bpe, token_orc, token_transducer
from govspark.llm.common import utf8

BYTES, WORDS = (public_tokenizers.path(f"{n}.json") for n in ("byte_bpe_50k", "word_bpe_49k"))


def strings(n=4000):
    rng = random.Random(1)
    letters = "abcdefghij  \n\t'sstremvlld  éüß1234٣   !?.,-—漢字\U0001F600\x1c\x85́"
    out = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    wide = lambda: chr(rng.choice([rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x2FFFF), rng.randint(32, 126)]))
    return out + ["".join(wide() for _ in range(20)) for _ in range(n // 8)] + [" " * 3000 + "x", "a" * 3000, "'", "<|endoftext"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(BYTES)


def test_encoder_equals_library_and_decodes(library):
    coder, texts = byte_bpe.encoder(BYTES), strings()
    for text, expected in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        ids = coder.encode(text)
        assert ids.tolist() == expected.ids, text
        assert coder.decode(ids).decode() == text


def test_every_token_is_its_own_encoding():
    coder = byte_bpe.encoder(BYTES)
    assert all(coder.piece(token) == [i] for i, token in enumerate(coder.vocabulary.tokens))


def test_transducer_equals_library(library):
    import pyarrow as pa

    texts = strings()
    expected = [len(e.ids) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    offsets, data = utf8(pa.array(texts))
    assert token_transducer.transducer(BYTES).counts(offsets, data).tolist() == expected


def test_transducer_after_its_table_was_emptied(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(token_transducer, "MOST_CELLS", 1)
    machine, texts = token_transducer.Transducer(BYTES), strings(200)
    for text in texts:
        offsets, data = utf8(pa.array([text]))
        assert machine.counts(offsets, data).tolist() == [len(library.encode(text, add_special_tokens=False).ids)]


def test_maps_of_long_runs_are_composed(library, monkeypatch):
    """A megabyte without a border takes few rounds, each of as many steps as the logarithm of the chunks."""
    machine, rng, rounds = token_transducer.Transducer(BYTES), random.Random(4), []
    plain = token_transducer.Transducer.composed

    def counted(self, *args):
        out = plain(self, *args)
        rounds.append(self.rounds)
        return out

    monkeypatch.setattr(token_transducer.Transducer, "composed", counted)
    any_of = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = ["x" * 77 + "a" * 1_000_000, any_of("abcdefghij", 100_000), "abc" * 60_000, any_of("0123456789", 30_000)]
    texts += ["-" * 50_001 + "=" * 5_000 + "-=" * 20_000, any_of("漢字語文", 20_000), ("q" * 300 + " ") * 40, " " * 9_000 + "x"]
    for text in texts:
        rounds.clear()
        assert machine.counts(*utf8(pa.array([text]))).tolist() == [len(library.encode(text, add_special_tokens=False).ids)], text[:9]
        assert 1 <= max(rounds) <= 8
    monkeypatch.setattr(token_transducer, "ROUNDS", 1)  # maps forget all but the last entries
    offsets, data = utf8(pa.array(texts[1:]))
    assert token_transducer.Transducer(BYTES).counts(offsets, data).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts[1:]]


def test_queries_on_odd_rows(frame, odd, library):
    docs = frame(odd)
    expected = [(i, library.encode(t or "", add_special_tokens=False).ids, t or "") for i, t in odd]
    got = byte_bpe.encoding_digests(docs, BYTES).collect()
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = [(i, len(x), sha(",".join(map(str, x))), sha(t)) for i, x, t in expected]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    got = token_transducer.token_counts(docs, BYTES, 512).collect()
    want = [(i, len(t.encode()), len(x), len(x) > 512) for i, x, t in expected]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    coded = byte_bpe.encoded(docs, BYTES)
    assert coded.columns == [*docs.columns, "ids", "decoded"]
    assert all(r["decoded"] == (r["text"] or "") for r in coded.collect())


def test_token_files(frame, odd, ready, tmp_path):
    library = Tokenizer.from_file(WORDS)
    path = str(tmp_path / "ids")
    token_orc.write_tokens(frame(odd), path, WORDS, parts=3)
    stored = token_orc.read_tokens(ready, path)
    got = sorted(map(tuple, token_orc.token_digests(stored).collect()), key=lambda r: r[1])
    start, want = 0, []
    for i, t in sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    plan = stored.filter("doc_id = 5").select("n_ids")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,5)" in plan and "ids:array" not in plan.split("ReadSchema")[-1]


def test_word_encoder_equals_library():
    library, coder = Tokenizer.from_file(WORDS), token_orc.WordEncoder(WORDS)
    for text in [*strings(1500), "The END. a.b, x., é, İ. don't. A,"]:
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_words_learned_together_equal_library():
    library, coder = Tokenizer.from_file(WORDS), token_orc.WordEncoder(WORDS)
    # White space to Unicode but not to ASCII, marks that join or fold, and special strings between.
    texts = strings(3000) + ["a\x85b x\u2003y", "e\u0301 \u0301 \u200d", "<|endoftext|> a<|endoftext|>b <|end", "x, y., z.,", "İ. ß,", "\x00 a\x00"]
    column = pa.array(["sliced away <|endoftext|>", None, *texts])[1:]
    ids, sizes = coder.encode_rows(column, token_orc.pack([7]))
    got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got[0] == [7] and len(got) == len(texts) + 1
    for text, found, expected in zip(texts, got[1:], library.encode_batch_fast(texts, add_special_tokens=False)):
        assert found == [*expected.ids, 7], text
    before = len(coder.words)
    coder.learn({b"thtily", "ré¡llement".encode(), b"###*", b"a'sb"})
    assert len(coder.words) == before + 4


def test_empty_tables(frame, ready, tmp_path):
    docs = frame([(1, "a")]).filter("doc_id < 0")
    assert byte_bpe.encoding_digests(docs, BYTES).count() == token_transducer.token_counts(docs, BYTES, 1).count() == 0
    token_orc.write_tokens(docs, str(tmp_path / "none"), WORDS)
    assert token_orc.token_digests(token_orc.read_tokens(ready, str(tmp_path / "none"))).count() == 0
