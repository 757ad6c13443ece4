"""Encoding of texts with the tokenizers library, word by word through a cache."""

from __future__ import annotations

import json
import os
import re
from codecs import charmap_decode
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Long stretches without a blank are encoded but not remembered.
_LONG = 64
_MOST = 1_000_000
#: Stretches that are encoded together.
_JOINED = 500
#: Marks that end a word and are split off by both kinds of tokenizer.
_MARKS = ",.;:!?"
_SPACES = [chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) != " "]
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Letters that no rule splits and no normalizer changes except to lower case, then ASCII marks.
_TAILED = re.compile(r"(\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-/:-@\[-`{-~]*)")
_KEPT = {0x09, *range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: The character that stands for each byte in a byte-level vocabulary; tabs stay, to part words.
_ALPHABET = "".join(chr(b) if b in _KEPT else chr(256 + b - sum(k < b and k != 0x09 for k in _KEPT)) for b in range(256))


class _Words:
    """Words and their ids: number i of the words has ``sizes[i]`` ids from ``starts[i]`` on in one array.

    Numbers follow the order in which words came, which is that of ``number`` too.
    """

    def __init__(self):
        self.number: dict[str, int] = {}
        self.n_ids = 0
        self.ids, self.starts, self.sizes, self.seen = (np.zeros(1 << 16, t) for t in ("<u4", "i8", "i8", "i4"))

    def find(self, words: list[str]) -> np.ndarray:
        """Number of each word, -1 if it is not known."""
        return np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))

    def add(self, words: list[str], sizes: np.ndarray, ids: np.ndarray) -> None:
        """New words, with their ids side by side."""
        n, m = len(self.number), len(self.number) + len(words)
        self.ids = _longer(self.ids, self.n_ids + len(ids))
        self.starts, self.sizes, self.seen = (_longer(a, m) for a in (self.starts, self.sizes, self.seen))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[n:m] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[n:m] = sizes
        self.seen[n:m] = 0
        self.number.update(zip(words, range(n, m)))
        self.n_ids += len(ids)

    def drop_last(self, n: int) -> None:
        for _ in range(n):
            self.n_ids -= int(self.sizes[self.number.popitem()[1]])

    def joined(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after the other, and where those of each word end."""
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[numbers] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.ids[at], ends

    def keep(self, most: int) -> None:
        """Only words that came in more than one slice stay, the most frequent ``most`` of them."""
        seen = self.seen[: len(self.number)]
        stay = np.argsort(-seen, kind="stable")[: min(most, int((seen > 1).sum()))]
        stay.sort()
        words, (ids, _), sizes, seen = list(self.number), self.joined(stay), self.sizes[stay], seen[stay] // 2
        self.number, self.n_ids = {}, 0
        self.add([words[i] for i in stay.tolist()], sizes, ids)
        self.seen[: len(seen)] = seen


def _longer(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` with room for ``n``, at least half as much again if it has to grow."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, len(a) + len(a) // 2), a.dtype)
    out[: len(a)] = a
    return out


class Encoder:
    """Ids of whole texts, as packed little-endian unsigned 32-bit integers.

    The library splits texts into words before it merges, so for the two kinds of tokenizer
    known here a text may be cut at blanks and each distinct stretch encoded once:

    * ``led``: byte-level words that take one blank in front.  A text is cut before a blank
      with other characters on both sides, and before a line end if the text has no other white space
      and no empty line; a stretch that begins with a line end has no blank in front.
    * ``dropped``: white space only separates words.  A text is cut at blanks and line ends.

    Many words are looked up together, by number.  All other tokenizers encode whole texts, and so are texts that hold the string of an added
    token, which the library finds before it splits.  A full cache keeps the words that came
    again and again, at most half of it, or is emptied.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = f.read()
        self.tokenizer = Tokenizer.from_str(spec)
        parsed = json.loads(spec)
        self.added = [t["content"].lower() for t in parsed.get("added_tokens") or ()]
        self.spaced = any(c.isspace() for a in self.added for c in a)
        self.kind = _kind(parsed)
        self.size = self.tokenizer.get_vocab_size()
        self.folds = '"Lowercase"' in spec
        self.marks = dict(zip(_MARKS, self._encode(list(_MARKS)))) if self.kind != "whole" else {}
        self.led = _Words()  # words after a blank, of ``dropped`` ones without it
        self.plain: dict[str, bytes] = {}
        self.tails: dict[str, np.ndarray] = {}
        self.letters, self.lead = None, ""
        vocab = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocab.values(), default=0) + 1, bool)  # ids that begin a word (``led``) or end it
        if self.kind == "led":
            self.lead = " "
            self.edge[[i for t, i in vocab.items() if t.startswith("\u0120")]] = True
        elif suffix := self.kind == "dropped" and _letters_stay(parsed) and parsed["model"].get("end_of_word_suffix"):
            self.edge[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        self.starts = self.edge | np.isin(np.arange(len(self.edge)), vocab.get("\u010a", -1))  # the same for words of letters
        if self.edge.any():
            self.letters = Tokenizer(self.tokenizer.model)
            self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def _encode(self, texts: list[str]) -> list[bytes]:
        done = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def _learn(self, parts: set[str]) -> dict[str, bytes]:
        """A table that has all of ``parts``: the cache itself, unless a part is too long for it."""
        cache = self.plain
        new = [p for p in parts if p not in cache]
        if len(cache) + len(new) > _MOST:
            cache.clear()
            new = list(parts)
        long, marked, words = [], [], set()
        for p in new:
            if len(p) > _LONG:
                long.append(p)
            elif p[-1:] in self.marks and _letters(p[:-1]):
                marked.append(p)
                if p[:-1] not in cache:
                    words.add(p[:-1])
            else:
                words.add(p)
        words = list(words)
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            cache.update(zip(some, self._encode(some)))
        for p in marked:
            cache[p] = cache[p[:-1]] + self.marks[p[-1]]
        if not long:
            return cache
        return cache | dict(zip(long, self._encode(long)))

    def _encode_joined(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and all ids; many parts are one text for the library.

        A call of the library costs more than the few letters of a part.  Parts hold no blank and have no white
        space at their ends.  After a blank, an id that begins with one begins a part; without, offsets tell.
        """
        if self.spaced:
            return self._encode_apart(parts)
        if self.kind == "led":
            return self._divided(parts, self.tokenizer, self.edge, [" " + " ".join(g) for g in _groups(parts)])
        sizes, ids = [], []
        groups = _groups(parts)
        for group, e in zip(groups, self.tokenizer.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            at = np.cumsum([0, *[len(p) + 1 for p in group]])[:-1]
            starts = np.array([o[0] for o in e.offsets], np.int64)
            sizes.append(np.diff(np.searchsorted(starts, at[1:] - 1), prepend=0, append=len(starts)))  # the blank belongs to what follows
            ids.append(np.array(e.ids, "<u4"))
        return np.concatenate(sizes), np.concatenate(ids)

    def _encode_letters(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of letters alone, which no rule splits: they go to the model in its own alphabet."""
        if self.letters is None:
            return self._encode_joined(parts)
        some = ["\t".join([self.lead + p for p in g] if self.lead else g) for g in _groups(parts)]
        if self.lead:
            some = [t.replace(" \n", "\n\t") for t in some]
        if self.folds:
            some = [t.lower() for t in some]
        return self._divided(parts, self.letters, self.starts, [charmap_decode(t.encode(), "strict", _ALPHABET)[0] for t in some])

    def _divided(self, parts: list[str], tokenizer, edge: np.ndarray, some: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = np.concatenate([np.array(e.ids, "<u4") for e in tokenizer.encode_batch_fast(some, add_special_tokens=False)])
        edges = np.flatnonzero(edge[ids])
        if len(edges) != len(parts):
            return self._encode_apart(parts)
        return np.diff(edges, append=len(ids)) if self.lead else np.diff(edges, prepend=-1), ids

    def _encode_apart(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        done = self._encode([p if p[:1] == "\n" else self.lead + p for p in parts])
        return np.array([len(b) // 4 for b in done], np.int64), np.frombuffer(b"".join(done), "<u4")

    def _learn_led(self, new: list[str]) -> int:
        """Add words to ``led``; the last of them, as many as returned, are too long to be remembered."""
        long, tailed, bases, tails, apart, letters, words, known = [], [], [], [], [], set(), set(), self.led.number
        for p in new:
            if len(p) > _LONG:
                long.append(p)
            elif m := _TAILED.fullmatch(p):
                base, tail = m.groups()
                if tail:
                    tailed.append(p)
                    bases.append(base)
                    tails.append(tail)
                if base not in known:
                    letters.add(base)
            elif not p or p.strip() != p:
                apart.append(p)
            else:
                words.add(p)
        plain = [*letters]
        plain.sort(key=str.isascii)
        for encode, parts in ((self._encode_letters, plain), (self._encode_joined, [*words])):
            for i in range(0, len(parts), 20_000):
                some = parts[i : i + 20_000]
                self.led.add(some, *encode(some))
        if apart:
            self.led.add(apart, *self._encode_apart(apart))
        if tailed:
            ids, ends = self.led.joined(self.led.find(bases))
            marks = self._tails(tails)
            sizes = np.array([len(t) for t in marks], np.int64)
            ids = np.insert(ids, np.repeat(ends, sizes), np.concatenate(marks))
            self.led.add(tailed, np.diff(ends, prepend=0) + sizes, ids)
        if long:
            self.led.add(long, *self._encode_apart(long))
        return len(long)

    def _tails(self, tails: list[str]) -> list[np.ndarray]:
        """Ids of the marks behind words."""
        new = list({t for t in tails if t not in self.tails})
        if len(self.tails) + len(new) > _MOST:
            self.tails.clear()
            new = list(set(tails))
        self.tails.update(zip(new, [np.frombuffer(b, "<u4") for b in self._encode(new)]))
        return [self.tails[t] for t in tails]

    def _numbers(self, words: list[str]) -> tuple[np.ndarray, int]:
        """Numbers of distinct words in ``led``, and how many are to be dropped from it after use."""
        at = self.led.find(words)
        for most in (_MOST // 2, 0):
            if len(self.led.number) + int((at < 0).sum()) > _MOST:
                self.led.keep(most)
                at = self.led.find(words)
        gaps = np.flatnonzero(at < 0)
        new = [words[i] for i in gaps.tolist()]
        n_long = self._learn_led(new)
        at[gaps] = self.led.find(new)
        self.led.seen[at] += 1
        return at, n_long

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the stretches between blanks, where those of each stretch end, and the first stretch of each text."""
        words = pc.split_pattern(texts, " ")
        coded = words.flatten().dictionary_encode()
        at, n_long = self._numbers(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        ids, ends = self.led.joined(at[coded.indices.to_numpy()])
        self.led.drop_last(n_long)
        return ids, ends, words.offsets.to_numpy()

    def _by_blank(self, texts: list[str]) -> list[bytes]:
        """Ids of texts that may be cut before each blank."""
        texts = [_lines_apart(t) for t in texts]
        ids, ends, to = self._split(pa.array(texts, pa.large_string()))
        firsts = [t.split(" ", 1)[0] for t in texts]  # no blank in front
        plain = self._learn(set(firsts))
        raw, ends = ids.tobytes(), 4 * ends
        return [plain[p] + raw[a:b] for p, a, b in zip(firsts, ends[to[:-1]].tolist(), ends[to[1:] - 1].tolist())]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        return [ids for some in self.slices(texts) for ids in some]

    def slices(self, texts: list[str | None]) -> Iterator[list[bytes]]:
        """The same in bounded slices: the words of a slice are looked up together."""
        at = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size > 1 << 22 or i == len(texts) - 1:
                yield self._slice([t or "" for t in texts[at : i + 1]])
                at, size = i + 1, 0

    def _slice(self, texts: list[str]) -> list[bytes]:
        if self.kind == "whole":
            return self._encode(texts)
        whole = [i for i, t in enumerate(texts) if self._has_added(t)]
        if whole:
            held = set(whole)
            out = self._by_word([t if i not in held else "" for i, t in enumerate(texts)])
            for i, ids in zip(whole, self._encode([texts[i] for i in whole])):
                out[i] = ids
            return out
        return self._by_word(texts)

    def _has_added(self, text: str) -> bool:
        low = text.lower()
        return any(a in low for a in self.added)

    def _by_word(self, texts: list[str]) -> list[bytes]:
        if self.kind == "dropped":
            folded = [(_folded(t) if self.folds else t).replace("\n", " ") for t in texts]
            ids, ends, to = self._split(pa.array(folded, pa.large_string()))
            raw, cuts = ids.tobytes(), (4 * ends[to[1:] - 1]).tolist()
            return [raw[a:b] for a, b in zip([0, *cuts], cuts)]
        out = [b""] * len(texts)
        simple = [i for i, t in enumerate(texts) if _simple(t)]
        if simple:
            for i, ids in zip(simple, self._by_blank([texts[i] for i in simple])):
                out[i] = ids
        if len(simple) < len(texts):
            held = set(simple)
            cut = {i: _CUT.split(t) for i, t in enumerate(texts) if i not in held}
            plain = self._learn(set().union(*cut.values()))
            for i, c in cut.items():
                out[i] = b"".join([plain[x] for x in c])
        return out


def _groups(parts: list[str]) -> list[list[str]]:
    return [parts[i : i + _JOINED] for i in range(0, len(parts), _JOINED)]


def _letters(word: str) -> bool:
    """Only letters that stay one letter each in lower case and combine with nothing."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and len(word.lower()) == len(word)))


def _folded(text: str) -> str:
    """A-Z in lower case if no character could combine with them; the tokenizer does the rest."""
    try:
        return text.encode("latin-1").lower().decode("latin-1")
    except UnicodeEncodeError:
        return text


def _simple(text: str) -> bool:
    """No blank stands beside other white space, so each may be cut off on its left."""
    if "  " in text:
        return False
    return not any(c in text and (c + " " in text or " " + c in text) for c in _SPACES)


def _lines_apart(text: str) -> str:
    """A blank before each line end, if that is the only white space beside single blanks."""
    if "\n" not in text or "\n\n" in text or any(c in text for c in _SPACES if c != "\n"):
        return text
    return text.replace("\n", " \n")


def _kind(spec: dict) -> str:
    pre, norm, model = spec.get("pre_tokenizer") or {}, spec.get("normalizer"), spec["model"]
    if model["type"] != "BPE" or model.get("dropout"):
        return "whole"
    if pre.get("type") == "ByteLevel" and norm is None and pre.get("use_regex") and not pre.get("add_prefix_space"):
        return "led"
    steps = pre.get("pretokenizers") or []
    drops = steps and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    safe = {"NFC", "Replace", "Lowercase"}
    if drops and r"[^\s\p{L}\p{N}]+" in str(steps[0]["pattern"].get("Regex")) and {n["type"] for n in (norm or {}).get("normalizers", [])} <= safe:
        return "dropped"
    return "whole"


def _letters_stay(spec: dict) -> bool:
    """A word of letters comes to the model of a ``dropped`` tokenizer as its bytes, in lower case at most."""
    byte_level = spec["pre_tokenizer"]["pretokenizers"][1:]
    replaced = [n for n in spec["normalizer"]["normalizers"] if n["type"] == "Replace"] if spec.get("normalizer") else []
    return (
        [(p["type"], p.get("use_regex"), p.get("add_prefix_space")) for p in byte_level] == [("ByteLevel", False, False)]
        and r"[\p{L}]+" in spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].split("|")
        and all(n["pattern"] == {"Regex": r"\s+"} for n in replaced)
    )


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
