"""The cached encoder equals the library on whole texts."""

import random

import duckdb
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barwright.llm.tokens import Encoder, keeps_ascii

ODD = ["", " ", "  a", "a  b", "a <|endoftext|> b", "<|endoftext|>.", "x\n y", "x \ny", "İ. b", "İstanbul ß ΑΣ. Σ b", "a b c", "a b ",
       "don't stop 's a's,'s", "é. ́e x", "日本 語 テ,", "a ​ b", "\t", "A1 2B. 33,", "a\n\nb", "a.\nb\nc\nd", "\n", "a\x01b c.", "a\x02b c", "\x02", "x.. y,.z",
       "a...\n\n b", "é.è,ê", "x\n.", ".\nx"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_library(name):
    path = public_tokenizers.path(name)
    mine, library = Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    bits = ["a", "B", "é", "İ", " ", " ", ".", ",", "\n", "'s", "1", "́", "ß", "日", "\x01", "\t", "|", "%", "the", "<|endoftext|>"]
    texts = ODD + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 20))) for _ in range(3000)]
    texts += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()]
    for k in range(0, len(texts), 97):
        part = texts[k:k + 97]
        ids, bounds = mine.encode(pa.array(part, pa.string()))
        for i, t in enumerate(part):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr("barwright.llm.tokens.MEMORY_PIECES", 5)
    path = public_tokenizers.path("byte_bpe_50k.json")
    mine, library = Encoder(path), Tokenizer.from_file(path)
    for text in ("a b c d", "e f g h i j k l", "a b", "x a y"):
        ids, _ = mine.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_new_pieces_go_to_the_library_together(name):
    path = public_tokenizers.path(name)
    mine, library, asked = Encoder(path), Tokenizer.from_file(path), []
    plain = mine.plain
    mine.plain = lambda texts: (asked.extend(texts), plain(texts))[1]
    rng = random.Random(5)
    signs = "abcdefgXYZ019'-<é日Σß"
    words = sorted({"".join(rng.choice(signs) for _ in range(rng.randint(1, 7))) for _ in range(2000)})
    text = " ".join(words)
    ids, _ = mine.encode(pa.array([text]))
    assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(asked) <= len(words) // 64 + 2


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_whose_bytes_change_are_encoded_alone(name):
    """The lower case of İ has another number of bytes, and so has a letter with its accent composed."""
    path = public_tokenizers.path(name)
    mine, library = Encoder(path), Tokenizer.from_file(path)
    words = [f"a{i}" for i in range(200)]
    words[70], words[140], words[199] = "xİy", "béc", "İİ"
    for text in (" ".join(words), "start " + " ".join(words[::-1]) + " </w> x</w>y end", "q " + "Ωm Åk " * 80 + "z"):
        ids, _ = mine.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
        ids, _ = mine.encode(pa.array([text]))  # now from the memory
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_ascii_pieces_are_not_normalized_by_themselves():
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, library, asked = Encoder(path), Tokenizer.from_file(path), []

    class Recorder:
        def normalize_str(self, text, own=mine.normalizer):
            asked.append(text)
            return own.normalize_str(text)

    assert mine.keeps_ascii
    mine.normalizer = Recorder()
    words = [f"{a}{b}" for a in ("AbC", "d-e", "É", "x\ty", "f\x7f,g") for b in range(150)]
    words += ["<|endoftext|>", "a<|EndOfText|>b", "<|STARTOFTEXT|>"]  # the lower case of these is no special token
    random.Random(8).shuffle(words)
    text = " ".join(["start", *words, "end"])
    for _ in range(2):
        ids, _ = mine.encode(pa.array([text]))
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert 0 < len(asked) < len(words) // 64


def test_normalizers_that_change_the_bytes_of_ascii():
    assert keeps_ascii({"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Lowercase"}]})
    for rule in ({"type": "Replace", "pattern": {"String": "a"}, "content": "bc"}, {"type": "Prepend", "prepend": "_"}, {"type": "Strip"},
                 {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": "__"}):
        assert not keeps_ascii(rule)
        assert not keeps_ascii({"type": "Sequence", "normalizers": [{"type": "NFC"}, rule]})


def test_pieces_asked_for_again_outlast_the_others(monkeypatch):
    monkeypatch.setattr("barwright.llm.tokens.MEMORY_PIECES", 600)
    path = public_tokenizers.path("word_bpe_49k.json")
    mine, library, new = Encoder(path), Tokenizer.from_file(path), []
    pieces = mine.pieces
    mine.pieces = lambda words: (new.extend(words), pieces(words))[1]
    often = [f"often{i}" for i in range(100)]
    for k in range(12):
        text = " ".join(["start", *often, *(f"once{k}x{i}" for i in range(100)), "start end.", "end, start"])
        column = pa.array([text, text[::-1], "", "start again", "start anew"])
        ids, bounds = mine.encode(column)
        for i, t in enumerate(column.to_pylist()):
            assert ids[bounds[i]:bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
        assert len(mine.known) <= 600
    assert new.count("often7") == 1
