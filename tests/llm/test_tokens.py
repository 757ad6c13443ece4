"""Word-wise encoding against the library on whole texts."""

import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pointloom.llm import tokens


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_equals_the_library(spark, name):
    path = public_tokenizers.path(name)
    whole = Tokenizer.from_file(path)
    rnd = random.Random(4)
    odd = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x1f", "\x85", "\xa0", " ", "　", "é", "́", "İ", "ß", "'s", "'", "12", "...", "<|endoftext|>", "日本", "🙂", "\0", "_", "ﬁ", "Σ", "."]
    texts = ["", " ", "\n", " a", "a ", None] + ["".join(rnd.choice(odd) for _ in range(rnd.randrange(1, 30))) for _ in range(3000)]
    texts += ["".join(rnd.choice("ab ,.!İıǅſKÅ;ǰ") + chr(rnd.randrange(1, 0x2FF)) + rnd.choice(["", "!", ".", " "]) for _ in range(6)) for _ in range(3000)]
    texts += ["".join(chr(rnd.choice([rnd.randrange(32, 0xD7FF), rnd.randrange(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(2000)]
    texts += ["hello <|endoftext|> world", "<|ENDOFTEXT|>", "a<|endoftext|>b", "<|endoftext|", "x <|startoftext|>  y", "<|endoftext|><|endoftext|>"]
    texts += [f"one {t['content']} two{t['content']}" for t in json.loads(whole.to_str())["added_tokens"]]
    texts += ["x" * 500, "word " * 300 + "y" * 200]
    texts += [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    enc = tokens.Encoder(path)
    assert enc.kind != "whole"
    got = [np.frombuffer(b, "<u4").tolist() for b in enc(texts)]
    want = [e.ids for e in whole.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    bad = [(t, g, w) for t, g, w in zip(texts, got, want) if g != w]
    assert not bad, bad[:3]


def test_full_cache_is_emptied(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST", 3)
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = enc.tokenizer
    for t in ("one two three four five", "six seven one", "a b c d"):
        assert np.frombuffer(enc([t])[0], "<u4").tolist() == whole.encode(t).ids


class Counted:
    """The library, and how often each word was given to it."""

    def __init__(self, tokenizer):
        self.tokenizer, self.words = tokenizer, Counter()

    def encode_batch(self, texts, **more):
        self.words.update(w for t in texts for w in t.split())
        return self.tokenizer.encode_batch(texts, **more)

    def encode_batch_fast(self, texts, **more):
        self.words.update(w for t in texts for w in t.split())
        return self.tokenizer.encode_batch_fast(texts, **more)


def test_words_that_come_again_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST", 40)
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole, enc.tokenizer = enc.tokenizer, Counted(enc.tokenizer)
    often = ["thereupon", "whereof", "naïvely", "odd***", "x|y"]
    for k in range(60):
        fresh = ["once" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10] + c + end for c in "uvwxyz" for end in ("", ",")]
        text = " ".join(["First", *often, *fresh, "thereupon."])
        assert np.frombuffer(enc([text])[0], "<u4").tolist() == whole.encode(text).ids
        assert len(enc.led.number) <= 40
    assert max(enc.tokenizer.words[w] for w in often) == 1


def test_slice_with_more_words_than_the_cache_and_long_ones(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST", 20)
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(6)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choice("abé1,.\n'") for _ in range(rnd.choice([1, 2, 3, 70]))) for _ in range(rnd.randrange(1, 30))) for _ in range(10)]
        got = [np.frombuffer(b, "<u4").tolist() for b in enc(texts)]
        assert got == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert max(map(len, enc.led.number), default=0) <= 64


def test_words_without_blanks_outlive_a_full_cache(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST", 40)
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    whole, enc.tokenizer = enc.tokenizer, Counted(enc.tokenizer)
    often = ["odd1", "it's", "x|y"]
    for k in range(60):
        fresh = ["once" + "abcdefghij"[k % 10] + "klmnopqrst"[k // 10] + c + end for c in "uvwxyz" for end in ("", ",")]
        text = " ".join(["First", *often, *fresh, "thereupon."])
        assert np.frombuffer(enc([text])[0], "<u4").tolist() == whole.encode(text).ids
        assert len(enc.led.number) <= 40
    assert max(enc.tokenizer.words[w] for w in often) == 1


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_letters_and_marks_go_to_the_model(name):
    enc = tokens.Encoder(public_tokenizers.path(name))
    whole, enc.tokenizer = enc.tokenizer, Counted(enc.tokenizer)
    text = "It naïvely, ÉCLAIR*** Straße ÿÀ!? hello hello. a×b µm it's"
    assert np.frombuffer(enc([text])[0], "<u4").tolist() == whole.encode(text).ids
    assert set(enc.tokenizer.words) - set(tokens._MARKS) <= {"It", "***", "!?", "a×b", "µm", "it's"}


def test_other_rules_for_words_of_letters(tmp_path):
    spec = json.loads(open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8").read())
    split, replace = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"], spec["normalizer"]["normalizers"][1]
    text = "Hello ÉCLAIR, naïve banana!! x"
    for change in (
        lambda: spec["normalizer"]["normalizers"].pop(),  # no lower case
        lambda: split.update(Regex=split["Regex"].replace(r"[\p{L}]+", r"\p{L}{1,3}")),
        lambda: replace.update(pattern={"Regex": "an"}, content="on"),
    ):
        change()
        path = tmp_path / "other.json"
        path.write_text(json.dumps(spec), encoding="utf-8")
        enc = tokens.Encoder(str(path))
        assert enc.kind == "dropped"
        assert np.frombuffer(enc([text, text])[1], "<u4").tolist() == enc.tokenizer.encode(text).ids


def test_dropped_blanks_with_more_words_than_the_cache(monkeypatch):
    monkeypatch.setattr(tokens, "_MOST", 20)
    enc = tokens.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(6)
    for _ in range(20):
        texts = [" ".join("".join(rnd.choice("abÉé1,.\n'*") for _ in range(rnd.choice([0, 1, 2, 3, 70]))) for _ in range(rnd.randrange(1, 30))) for _ in range(10)]
        got = [np.frombuffer(b, "<u4").tolist() for some in enc.slices(texts) for b in some]
        assert got == [e.ids for e in enc.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert max(map(len, enc.led.number), default=0) <= 64


def test_stretches_are_cut_before_line_ends():
    enc = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    whole, enc.tokenizer = enc.tokenizer, Counted(enc.tokenizer)
    rnd = random.Random(8)
    texts = ["It was here.\nThe end\nof, É\n(all) it\n", "\nA b", "a\n\nb c", "a\n\n", "a\tb\nc\t\n", "x y\n" + "z" * 90 + "\n5"]
    assert np.frombuffer(enc(texts[:1])[0], "<u4").tolist() == whole.encode(texts[0]).ids
    assert set(enc.tokenizer.words) - set(tokens._MARKS) <= {"It", "(all)"}
    texts += ["".join(rnd.choice("aÉ. \n'1") for _ in range(rnd.randrange(1, 12))) for _ in range(3000)]
    got = [np.frombuffer(b, "<u4").tolist() for b in enc(texts)]
    assert got == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
