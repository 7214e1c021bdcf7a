"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared in a plain form: letters and digits in lower case, everything else one space. A region of a benchmark item
that a document holds with at most RATE edits a character shares all but Q q-grams per edit with it, and they lie on diagonals
no further apart than the edits. So shared q-grams are counted per item in bands of diagonals; bands overlap by half, so one of
them holds all diagonals of a region. Bands whose count reaches the bound for the shortest region that matters are aligned
within the band; a document is contaminated by an item if it holds a region that covers REGION characters of it, or all of a
shorter item, within the edit budget, wherever the edits lie. The best local alignment shows most such regions; where it
doesn't, the furthest reach from each place of the item with each number of edits decides. Items so short that edits may leave
no q-gram of Q characters are looked up by q-grams of SHORT_Q.

Items come in blocks of bounded size, each broadcast as a sorted array of q-grams; every document is read whole against every
block and no pair of documents or items is formed.

Defined cases: null and empty texts and items match nothing; items whose plain form is shorter than Q characters are no
evidence and match nothing; repeated items and documents are reported for each id; a null id is reported as null; a document of
any length is read once per block; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from busloom.llm.common import filter_texts, over_texts

#: Length of a q-gram, edits allowed per character, and the shortest region of an item that counts, in plain characters.
Q, RATE, REGION = 12, 0.05, 80
#: Length of a q-gram for items whose edits may leave none of Q characters.
SHORT_Q = 10
#: Characters of items in one block, and what an edit costs in an alignment against 1 for a match.
BLOCK_CHARS, COST = 4_000_000, 10
FILTER_BITS = 20
#: Starts that are followed at a time.
STARTS = 1 << 17
ODD = np.uint64(0x9E3779B97F4A7C15)

PLANE = 1 << 16


def plain_table() -> np.ndarray:
    """For each code point of the first plane its letter or digit in lower case, or a space."""
    chars = [chr(c) if not 0xD800 <= c < 0xE000 else " " for c in range(PLANE)]
    return np.array([ord(low) if c.isalnum() and len(low := c.lower()) == 1 else ord(c) if c.isalnum() else 32 for c in chars], dtype=np.uint32)


TABLE = plain_table()


def plain(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The plain form's code points and the place of each in the text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    form = TABLE[np.minimum(code, PLANE - 1)] if not len(code) or code.max() < PLANE else np.where(code < PLANE, TABLE[np.minimum(code, PLANE - 1)], code)
    blank = form == 32
    at = np.flatnonzero(~(blank & np.concatenate([[True], blank[:-1]])))
    if len(at) and blank[at[-1]]:
        at = at[:-1]
    return form[at], at


def grams(form: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit code of each q-gram."""
    if len(form) < q:
        return np.empty(0, np.uint64)
    code, size = form.astype(np.uint64), 1
    whole, done = None, 0
    left = q
    while left:  # powers of two are joined into q
        if left & 1:
            whole = code[done : done + len(form) - q + 1] * ODD if whole is None else (whole ^ code[done : done + len(form) - q + 1]) * ODD
            whole ^= whole >> np.uint64(29)
            done += size
        left >>= 1
        if left:
            code = (code[:-size] * ODD) ^ (code[:-size] >> np.uint64(31)) ^ (code[size:] * np.uint64(0xC2B2AE3D27D4EB4F))
            size *= 2
    return whole


def needed(size: int, q: int = Q) -> int:
    """Shared q-grams of a region of that many characters within its edit budget; none are sure if it is below 1."""
    return size + 1 - q - q * int(size * RATE)


@dataclass
class Grams:
    """The q-grams of items: sorted codes, and where each occurs."""

    q: int
    codes: np.ndarray
    first: np.ndarray
    item: np.ndarray
    place: np.ndarray
    maybe: np.ndarray
    least: int


@dataclass
class Index:
    """A block of items and their q-grams by length."""

    ids: list
    forms: list[np.ndarray]
    tables: list[Grams]
    bound: np.ndarray
    width: int


def grams_of(forms: list[np.ndarray], of: np.ndarray, q: int, bound: np.ndarray) -> Grams:
    """The q-grams of the items at the places `of`."""
    codes = [grams(forms[i], q) for i in of]
    flat = np.concatenate(codes)
    item = np.repeat(of, [len(c) for c in codes]).astype(np.int64)
    place = np.concatenate([np.arange(len(c)) for c in codes]).astype(np.int64)
    order = np.argsort(flat, kind="stable")
    unique, first = np.unique(flat[order], return_index=True)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    maybe[(unique >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
    return Grams(q, unique, np.append(first, len(flat)), item[order], place[order], maybe, int(bound[of].min()))


def index(items: list[tuple[int, str]]) -> Index:
    kept = [(i, f) for i, t in items if len(f := plain(t or "")[0]) >= Q]
    forms = [f for _, f in kept]
    sizes = [min(REGION, len(f)) for f in forms]
    q = np.array([Q if needed(n) >= 1 else SHORT_Q for n in sizes], np.int64)
    bound = np.array([needed(n, k) for n, k in zip(sizes, q.tolist())], np.int64)
    width = 2 * max((int(len(f) * RATE) for f in forms), default=0) + 2
    return Index([i for i, _ in kept], forms, [grams_of(forms, np.flatnonzero(q == k), int(k), bound) for k in np.unique(q)], bound, width)


def bands(ix: Index, form: np.ndarray) -> list[tuple[int, int]]:
    """(item, first diagonal) of the bands that share enough q-grams; a diagonal is the place in the text less that in the item."""
    return sorted({x for g in ix.tables for x in bands_by(ix, g, form)})


def bands_by(ix: Index, g: Grams, form: np.ndarray) -> list[tuple[int, int]]:
    code = grams(form, g.q)
    if not len(code):
        return []
    at = np.flatnonzero(g.maybe[(code >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    k = np.minimum(np.searchsorted(g.codes, code[at]), len(g.codes) - 1)
    hit = g.codes[k] == code[at]
    at, k = at[hit], k[hit]
    if len(at) < g.least:
        return []
    times = g.first[k + 1] - g.first[k]
    row = np.repeat(g.first[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    item, diagonal = g.item[row], np.repeat(at, times) - g.place[row]
    found, where = [], np.repeat(at, times)
    half = ix.width // 2
    for shift in (0, half):
        band = (diagonal + shift) // ix.width
        # occurrences of one q-gram in one band count once per place of the text
        key = (item << 34) + (band + (1 << 33))
        order = np.lexsort((where, key))
        k, w = key[order], where[order]
        new = np.concatenate([[True], (k[1:] != k[:-1]) | (w[1:] != w[:-1])])
        pair, count = np.unique(k[new], return_counts=True)
        of, band = pair >> 34, (pair & ((1 << 34) - 1)) - (1 << 33)
        good = count >= ix.bound[of]
        found += [(int(i), int(b) * ix.width - shift) for i, b in zip(of[good], band[good])]
    return found


def align(item: np.ndarray, text: np.ndarray, start: int, width: int) -> tuple[int, int, int, int, int]:
    """Best local alignment on the diagonals start .. start + width - 1: (item from, to, text from, to, edits)."""
    m, n, c = len(item), len(text), np.arange(width)
    for k in range(max(start, 0), min(start + width, n - m + 1)):  # the whole item as it is
        if text[k] == item[0] and np.array_equal(text[k : k + m], item):
            return 0, m, k, k + m, 0
    score = np.zeros((m + 1, width), np.int64)
    for i in range(1, m + 1):
        j = i - 1 + start + c
        fits = (j >= 0) & (j < n)
        same = fits & (text[np.clip(j, 0, max(n - 1, 0))] == item[i - 1])
        best = np.maximum(score[i - 1] + np.where(same, 1, -COST), np.append(score[i - 1, 1:], 0) - COST)
        best = np.where(fits, np.maximum(best, 0), 0)
        score[i] = np.maximum.accumulate(best + COST * c) - COST * c
        score[i, ~fits] = 0
    i, k = divmod(int(score.argmax()), width)
    to_item, to_text, edits = i, i + start + k, 0
    while i > 0 and score[i, k] > 0:
        j, s = i - 1 + start + k, score[i, k]
        same = text[j] == item[i - 1]
        if s == score[i - 1, k] + (1 if same else -COST):
            i, edits = i - 1, edits + (not same)
        elif k + 1 < width and s == score[i - 1, k + 1] - COST:
            i, k, edits = i - 1, k + 1, edits + 1
        elif k and s == score[i, k - 1] - COST:
            k, edits = k - 1, edits + 1
        else:  # a match begins here
            i, k = i - 1, k
            break
    return i, to_item, i + start + k, to_text, edits


def furthest(item: np.ndarray, text: np.ndarray, start: int, width: int) -> tuple[int, int, int, int, int] | None:
    """The longest region within its budget on those diagonals, as align gives it, or None if there is none.

    One half of a region of 2 * REGION characters or more is within the half's own budget, so there is a shorter one, of few
    edits. From each start and for each number of edits the furthest place on each diagonal is all that counts.
    """
    m, n, c = len(item), len(text), np.arange(width)
    least, most = min(REGION, m), int(min(m, 2 * REGION - 1) * RATE)
    run = np.zeros((m + 1, width), np.int32)  # characters alike from here on
    for i in range(m - 1, -1, -1):
        j = i + start + c
        run[i] = np.where((j >= 0) & (j < n) & (text[np.clip(j, 0, n - 1)] == item[i]), run[i + 1] + 1, 0)
    limit = np.minimum(m, n - start - c)
    best, rows = None, max(1, STARTS // width)
    for low in range(0, m - least + 1, rows):
        a, k = map(np.ravel, np.mgrid[low : min(low + rows, m - least + 1), 0:width])
        # a start that the same diagonal reaches from one character before is no better than that one
        fresh = (a + start + k >= 0) & (a <= limit[k]) & ((a == 0) | (run[np.maximum(a - 1, 0), k] == 0))
        a, k = a[fresh], k[fresh]
        if not len(a):
            continue
        none = np.full(len(a), -m - 2)
        reach = {0: a + run[a, k]}
        for e in range(most + 1):
            if e:
                last, reach = reach, {}
                for d in range(-e, e + 1):
                    # a changed character, one more in the text, one less in the text
                    to = np.maximum(np.maximum(last.get(d, none) + 1, last.get(d - 1, none)), last.get(d + 1, none) + 1)
                    at = np.clip(k + d, 0, width - 1)
                    to = np.minimum(to, limit[at])
                    reach[d] = np.where((to >= 0) & (at == k + d), to + run[np.maximum(to, 0), at], none)
            for d, to in reach.items():
                x = int((to - a).argmax())
                size = int(to[x] - a[x])
                if size >= least and e <= int(size * RATE) and (best is None or size > best[1] - best[0]):
                    best = int(a[x]), int(to[x]), int(a[x] + start + k[x]), int(to[x] + start + k[x] + d), e
    return best


def regions(ix: Index, text: str) -> list[tuple[int, int, int, int, int, int]]:
    """(item, text from, to, item from, to, edits), in code points of the text and plain characters of the item; one per place."""
    form, at = plain(text)
    out: dict[tuple[int, int], tuple] = {}
    for i, start in bands(ix, form):
        item = ix.forms[i]
        held = align(item, form, start, ix.width)
        if held[1] - held[0] < min(REGION, len(item)) or held[4] > int((held[1] - held[0]) * RATE):
            held = furthest(item, form, start, ix.width)
        if held:
            a, b, c, d, edits = held
            found = (i, int(at[c]), int(at[d - 1]) + 1, a, b, edits)
            known = out.get((i, c))
            if known is None or known[2] < found[2]:
                out[(i, c)] = found
    kept: list[tuple] = []
    for r in sorted(out.values(), key=lambda r: (r[0], r[1], -r[2])):
        if not kept or kept[-1][0] != r[0] or r[1] >= kept[-1][2]:
            kept.append(r)
    return kept


def blocks(spark, items: DataFrame):
    """The items' indexes, one block of bounded size after the other, each broadcast."""
    items = items.select(F.col("item_id").cast("long"), "text").where(F.length("text") >= Q)
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // BLOCK_CHARS)
    for k in range(count):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(count)) == k).collect()
        yield spark.sparkContext.broadcast(index([(r.item_id, r.text) for r in rows]))


REGION_FIELDS = ("item_id", "doc_start", "doc_end", "item_start", "item_end", "edits")


def apply(docs: DataFrame, items: DataFrame) -> DataFrame:
    """One row per contaminated place: doc_id, item_id, its span in the text, the item's span in plain form, edits."""
    kind = "array<struct<item_id:long,doc_start:int,doc_end:int,item_start:int,item_end:int,edits:int>>"
    out = None
    for sent in blocks(docs.sparkSession, items):

        def run(texts, sent=sent):
            ix = sent.value
            return {"found": [[dict(zip(REGION_FIELDS, (ix.ids[r[0]], *r[1:]))) for r in regions(ix, x)] for x in texts]}

        part = over_texts(docs, run, f"found {kind}").select("doc_id", F.explode("found").alias("r")).select("doc_id", "r.*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.select("doc_id", F.explode(F.lit(None).cast(kind)).alias("r")).select("doc_id", "r.*")
    return out


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without a contaminated place, with all their columns."""
    for sent in blocks(docs.sparkSession, items):
        docs = filter_texts(docs, lambda texts, sent=sent: np.array([not regions(sent.value, x) for x in texts], dtype=bool))
    return docs
