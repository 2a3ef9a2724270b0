import random
import unicodedata

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabulon.llm import sentencepiece_codec as sc
from tabulon.llm import token_counts as tc
from tests.llm.conftest import ODD

LETTERS = "abcdeorst'’ \n.,!?0123ÉéßΣσİıǅ ½²٣漢字😀́​\x1c\x85'sll<|endoftext|>▁"


def texts(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    out = ["", " ", "it's we're 'll ''s 's's", "ΑΣ ΣΑΣ", "a" * 3000, "thtion" * 300, " " * 50 + "x", "<s>x</s><unk><0x41>\0", "<|endoftext|>x<|startoftext|>"]
    out += ["".join(r.choice(LETTERS) for _ in range(r.randint(1, 60))) for _ in range(n)]
    return out + ["".join(r.choice("etaoin shrdlu'") for _ in range(r.randint(1, 400))) for _ in range(n // 4)]


def test_counts_equal_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = tc.TokenCounter(open(path, encoding="utf-8").read())
    t = texts(1, 400)
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(t, add_special_tokens=False)]
    assert counter.counts(t).tolist() == want


def test_counts_of_characters_that_python_does_not_know_yet():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter = tc.TokenCounter(open(path, encoding="utf-8").read())
    new = [c for a, z in (*tc.NEW_LETTERS, *tc.NEW_NUMBERS, (0x378, 0x3A2), (0xA7CE, 0xA7F1)) for c in range(a, min(z, a + 60) + 1)]
    t = [f"a{chr(c)}b{chr(c)}{chr(c)}1" for c in new]
    assert counter.counts(t).tolist() == [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(t, add_special_tokens=False)]


def test_counts_of_marks_in_sequence():
    path = public_tokenizers.path("word_bpe_49k.json")
    counter, library = tc.TokenCounter(open(path, encoding="utf-8").read()), Tokenizer.from_file(path)
    marks = [chr(c) for c in range(0x110000) if unicodedata.combining(chr(c))]
    t = [f"a{x}{m}{y}b" for m in marks for x in ("", "\u0307", "\u0323", "\u0302") for y in ("", "\u0307", "\u0323", "\u0302", m)]
    t += ["T\u08d1\u0307", "\u0307\u0c3c", "\u0307\u1dfa", "\u0307\U00011070", "G\u1df6\u0302", "\u1df6\u0307", "H\u0d3b\u0307", "\U00011935\U00011930\u0307", "\U00011938\u0323\u0307", "\u1100\u1161\u11a8"]
    r = random.Random(6)
    odd = [*"aeoTGHш\u1100\u1161\u11a8\u0915\u09c7\u09be가", *"\u0307\u0323\u0302\u0300\u0345\u0338\u093c\u05b0\u3099", *r.sample(marks, 300), *[chr(c) for a, z in tc.NEWER_MARKS for c in range(a, z + 1)]]
    t += ["".join(r.choices(odd, k=r.randint(2, 7))) for _ in range(200_000)]
    for lo in range(0, len(t), 20_000):
        part = t[lo : lo + 20_000]
        assert counter.counts(part).tolist() == [len(e.ids) for e in library.encode_batch(part, add_special_tokens=False)]


def test_chunk_maps_compose_alike_for_any_chunk_length(monkeypatch):
    counter = tc.TokenCounter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    t = texts(2, 60)
    want = counter.counts(t).tolist()
    for size in (1, 2, 3, 7, 100_000):
        monkeypatch.setattr(tc, "CHUNK", size)
        assert counter.counts(t).tolist() == want


def test_tables_can_be_emptied_between_batches():
    counter = tc.TokenCounter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    want = counter.counts(texts(3, 50)).tolist()
    counter.machine.max_states = counter.machine._most = 10
    assert counter.counts(texts(3, 50)).tolist() == want


def test_pieces_equal_the_library_and_decode():
    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, sp = sc.PieceCodec(open(path, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=path)
    t = texts(4, 400)
    ids, ends = codec.encode(t)
    got = [x.tolist() for x in np.split(ids, ends[:-1])]
    assert got == sp.encode(t)
    assert [codec.decode(x) for x in got] == sp.decode(got)


def test_tables_stay_bounded_within_one_long_text():
    counter = tc.TokenCounter(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    r = random.Random(5)
    text = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12000)), "".join(r.choice(LETTERS) for _ in range(5000))]
    want = [len(e.ids) for e in Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode_batch(text, add_special_tokens=False)]
    counter.machine.max_states = counter.machine._most = 300
    assert counter.counts(text).tolist() == want and len(counter.machine._states) < 2000
    codec, sp = sc.PieceCodec(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()), sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codec.machine.max_states = codec.machine._most = 300
    ids, ends = codec.encode(text)
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == sp.encode(text) and len(codec.machine._states) < 5000


def test_models_of_other_kinds_are_refused():
    data = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
    assert len(sc.read_model(data)) == 32000
    for wrong in (b"\x12\x02\x18\x01", b"\x1a\x03\x12\x01x", b"\x1a\x02\x18\x00"):
        with pytest.raises(ValueError):
            sc.read_model(data + wrong)


def test_odd_rows(spark, odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = tc.token_counts(odd, path).collect()
    library = Tokenizer.from_file(path)
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in ODD)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert tc.token_counts(none, path).count() == 0


def test_round_trip_of_odd_rows(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    back = sc.decode(sc.encode(odd, path), path).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r[0]), r[1] or "") for r in ODD)
    assert all(r.round_trip for r in sc.encode_and_check(odd, path).collect())
    assert sc.encode(none, path).count() == 0


def test_a_tokenizer_of_another_kind_is_refused():
    with pytest.raises(ValueError):
        tc.TokenCounter('{"model": {"type": "WordPiece", "vocab": {}}, "added_tokens": []}')
