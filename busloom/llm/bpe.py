"""Byte-pair encoding by speculation: propose by greedy longest match, verify pairs, merge only what fails.

A word's tokens are proposed by longest match against the vocabulary. A proposal is what merging would give exactly if each
adjacent pair of it is, that is if merging the two tokens' joined text gives back those two tokens. The pairs of all new
words of a batch are looked up in one sorted array; a pair seen for the first time is merged once and remembered. Words with
a pair that fails are merged exactly. Every worker keeps bounded tables of words and pairs.

The vocabulary file is a parameter, read by each worker. Normalisation, splitting and special tokens are those of the file's
library: special strings are cut out of the raw text first, the rest is composed (NFC), lower-cased code point by code point
and split into words by the file's pattern, everything between words being dropped.

Defined cases: null and empty texts have no tokens; repeated rows encode alike; a word of any length is merged in n log n;
other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame

from busloom.llm.common import over_texts, utf8

#: Words and pairs that a worker remembers; a full table is begun anew.
WORDS, PAIRS = 400_000, 2_000_000
#: Stands for the end of a word; a private code point that byte symbols never use.
END = "\ue000"


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself if it is printable Latin-1, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.name = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        blank = r"\t-\r \x85\xa0  -     　"
        self.split = regex.compile(split.replace(r"[^\s", f"[^{blank}"))
        self.split_ascii = re.compile(split.replace(r"[^\s", r"[^\t-\r ").replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9"))  # of lower-case text
        self.symbol = str.maketrans({b: s for b, s in enumerate(byte_symbols())})
        # vocabulary by what a token spells, its end marked by END
        spelling = {s: s for s in byte_symbols()} | {s + suffix: s + END for s in byte_symbols()}
        self.rank, self.whole, self.id_of = {}, [], {spelling[t]: i for t, i in model["vocab"].items() if t in spelling}
        for k, (a, b) in enumerate(model["merges"]):
            spelling[a + b] = whole = spelling[a] + spelling[b]
            self.id_of[whole] = model["vocab"][a + b]
            self.rank.setdefault((self.id_of[spelling[a]], self.id_of[spelling[b]]), k)
            self.whole.append(self.id_of[whole])
        self.spelling = {i: s for s, i in self.id_of.items()}
        self.longest: dict[str, int] = {}
        for s in self.id_of:
            self.longest[s[:2]] = max(self.longest.get(s[:2], 0), len(s))
        self.size = max(self.name) + 1
        self.id_text = [str(i) for i in range(self.size)]
        self.id_name = [self.name.get(i, "") for i in range(self.size)]
        self.words: dict[str, tuple[int, ...]] = {}
        self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)

    def spelled(self, word: str) -> str:
        return utf8(word).decode("latin-1").translate(self.symbol) + END

    def propose(self, s: str) -> list[int]:
        """Greedy longest match; END never stands alone."""
        out, at, n = [], 0, len(s)
        while at < n:
            stop = min(n, at + self.longest.get(s[at : at + 2], 1))
            while True:
                if stop != n - 1 and (i := self.id_of.get(s[at:stop])) is not None:
                    break
                if stop <= at + 1:
                    stop = at + (2 if at + 2 == n else 1)
                    i = self.id_of[s[at:stop]]
                    break
                stop -= 1
            out.append(i)
            at = stop
        return out

    def merge(self, s: str) -> list[int]:
        """Exact merging: the pair of lowest rank first, of equal ranks the leftmost."""
        ids = [self.id_of[c] for c in s[:-2]] + [self.id_of[s[-2:]]] if s.endswith(END) else [self.id_of[c] for c in s]
        if len(ids) > 64:
            return self.merge_long(ids)
        rank, none = self.rank.get, len(self.whole)
        ranks = [rank(p, none) for p in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            ids[k] = self.whole[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = rank((ids[k], ids[k + 1]), none)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over a linked list."""
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(r, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (r := self.rank.get((ids[k], ids[k + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j < 0 or ids[j] != b:
                continue
            ids[k], ids[j] = self.whole[r], -1
            after[k] = after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := self.rank.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return [i for i in ids if i >= 0]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair whether merging its joined spelling gives that pair; right = size: the left token alone."""
        codes, where = np.unique(left * (self.size + 1) + right, return_inverse=True)
        at = np.searchsorted(self.known, codes)
        new = codes[(at == len(self.known)) | (self.known[np.minimum(at, len(self.known) - 1)] != codes)] if len(self.known) else codes
        if len(new):
            verdict = []
            for code in new.tolist():
                pair = [i for i in divmod(code, self.size + 1) if i < self.size]
                verdict.append(self.merge("".join(self.spelling[i] for i in pair)) == pair)
            if len(self.known) + len(new) > PAIRS + len(codes):  # begun anew with what this batch needs
                self.known, self.fits = np.empty(0, np.int64), np.empty(0, bool)
                return self.compatible(left, right)
            order = np.argsort(both := np.concatenate([self.known, new]), kind="stable")
            self.known, self.fits = both[order], np.concatenate([self.fits, np.array(verdict, bool)])[order]
            at = np.searchsorted(self.known, codes)
        return self.fits[at][where]

    def learn(self, words: list[str]) -> None:
        """Tokens of new words into the word table."""
        spelled = [self.spelled(w) for w in words]
        proposed = [self.propose(s) for s in spelled]
        sizes = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(sizes.sum()))
        starts = np.cumsum(sizes) - sizes
        right = np.append(flat[1:], self.size)
        right[starts[1:] - 1] = self.size  # the last token of a word has no right neighbour
        checked = np.ones(len(flat), bool)
        checked[starts + sizes - 1] = sizes == 1
        good = np.ones(len(flat), bool)
        good[checked] = self.compatible(flat[checked], right[checked])
        for w, s, ids, ok in zip(words, spelled, proposed, np.logical_and.reduceat(good, starts)):
            self.words[w] = tuple(ids if ok else self.merge(s))

    def split_words(self, text: str) -> list[str]:
        """Words in order; a special token's string stands for itself."""
        if text.isascii():
            return self.split_ascii.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # capital sigma: one small form everywhere
        return self.split.findall(text.lower())

    def encode(self, texts: list[str]) -> list[list[int]]:
        parts = [self.cut.split(x) if any(t in x for t in self.special) else [x] for x in texts]
        split = [[[p] if k % 2 else self.split_words(p) for k, p in enumerate(x)] for x in parts]
        if len(self.words) > WORDS:
            self.words.clear()
        words = set(chain.from_iterable(chain.from_iterable(x[::2] for x in split)))
        if new := [w for w in words if w not in self.words]:
            self.learn(new)
        get = self.words.__getitem__
        plain = lambda words: chain.from_iterable(map(get, words))
        return [list(chain.from_iterable([self.special[p[0]]] if k % 2 else plain(p) for k, p in enumerate(x))) for x in split]

    def decode(self, ids: list[int]) -> str:
        """Without a decoder in the file, tokens are joined by one space."""
        return " ".join(map(self.id_name.__getitem__, ids))


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The carried columns and `ids`, the tokens of the whole text."""
    return over_texts(docs, lambda texts: {"ids": codec(path).encode(texts)}, "ids array<int>", carry, text)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, number of tokens, and digests of the ids and of the text decoded from them."""

    def run(texts):
        c = codec(path)
        ids = c.encode(texts)
        sha = lambda s: hashlib.sha256(utf8(s)).hexdigest()
        return {
            "n_tokens": list(map(len, ids)),
            "ids_sha256": [sha(" ".join(map(c.id_text.__getitem__, x))) for x in ids],
            "decoded_sha256": [sha(c.decode(x)) for x in ids],
        }

    return over_texts(docs, run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
