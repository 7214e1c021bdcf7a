"""Spelling variants: words one edit apart, found through an index of variable-length grams.

  1. Words are letter runs of whole texts, with the planted deletions of the contract, counted in tasks before they are shuffled.
  2. The gram dictionary holds all grams of two letters of the words (with a mark at each end), and longer ones up to a limit whose
     beginning is frequent: branches that are rare are pruned. At most GRAMS beginnings are frequent, since the limit rises with the
     number of grams counted; they go to all tasks as hashes.
  3. A word is decomposed left to right into the longest dictionary grams, without those inside an earlier one. Words of b and
     b + 1 letters are compared with grams of at most (b + 2) / 2 letters, LONGEST at most.
  4. An edit at a place affects the grams that hold it, those before it that could grow into it, and those after it that a grown one
     could swallow. A word's bound is what the worst place leaves; with these lengths the first or the last gram is always left,
     so it is 1 at least. Two near words share so many grams at places that differ by 0 or, where lengths differ, 0 or 1.
  5. So of all lists only those of a word's rarest grams are merged, its grams less its bound plus one: near words meet in one of
     them. They are joined by (lengths, gram, place), and each pair that meets is verified by its edit distance.
  6. Forms are picked from verified neighbours, roots by doubling along forms; n at least doubles at each, so few rounds do.

Defined cases: null and empty texts hold no word; a null id counts as an empty id text in the deletions; repeated rows count each;
ties go to the smaller word; a letter run of any length is a word; a word without a neighbour has a null form and itself for root; an
empty table gives no rows; other columns aren't read. Grams and places are told apart by 64-bit hashes, verified afterwards.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from busloom.llm.common import keep, slices, utf8
from busloom.llm.jaccard import BASE, LETTERS, mixed, powers

LEAST_LETTERS, LEAST_TIMES, DELETED = 5, 3, 97
#: Longest gram; a beginning above RARE is frequent, with at most GRAMS of them.
LONGEST, RARE, GRAMS = 4, 30, 1 << 19
#: Distinct words that a task holds before it hands them on.
HELD = 400_000


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


CRC = crc_table()
#: Runs of more bytes get their crc one by one.
STEPPED = 64


def crcs(data: np.ndarray, first: np.ndarray, last: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of data[first:last], each carried on from a crc already there; all runs step through their bytes together."""
    size = last - first
    order = np.argsort(-size, kind="stable")
    at, left, s = first[order], size[order], state[order] ^ np.uint32(0xFFFFFFFF)
    short = int(np.searchsorted(-left, -STEPPED, side="left"))  # runs before this are longer
    raw = data.tobytes() if short else b""
    for k in range(short):
        s[k] = zlib.crc32(raw[at[k] : at[k] + left[k]], int(s[k] ^ np.uint32(0xFFFFFFFF))) ^ 0xFFFFFFFF
    for k in range(int(left[short]) if short < len(left) else 0):
        stop = int(np.searchsorted(-left, -k, side="left"))
        part = s[short:stop]
        s[short:stop] = CRC[(part ^ data[at[short:stop] + k]) & np.uint32(255)] ^ (part >> np.uint32(8))
    out = np.empty(len(s), np.uint32)
    out[order] = s ^ np.uint32(0xFFFFFFFF)
    return out


def count_words(ids: list[str], texts: list[str], into: Counter) -> None:
    """Adds the words of the texts (UTF-8) to the counter."""
    raws = [utf8(x).lower() for x in texts]  # bytes: A-Z alone
    raw = b"\n".join(raws)
    a = np.frombuffer(raw, np.uint8)
    wide = a == 0xC3  # with its second byte the letters U+00C0 to U+00FF
    letter = ((a >= 97) & (a <= 122)) | wide
    letter[1:] |= wide[:-1]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    wides = np.concatenate([[0], np.cumsum(wide)])
    size = (last - first) - (wides[last] - wides[first])
    long_enough = size >= LEAST_LETTERS
    first, last, size = first[long_enough], last[long_enough], size[long_enough]
    if not len(first):
        return
    starts = np.cumsum([0] + [len(r) + 1 for r in raws[:-1]])
    states = np.array([zlib.crc32(utf8(f"{i}:")) for i in ids], dtype=np.uint32)
    h = crcs(a, first, last, states[np.searchsorted(starts, first, side="right") - 1])
    struck = h % DELETED == 0
    for k in np.flatnonzero(struck):
        word = raw[first[k] : last[k]].decode("utf-8")
        if len(word) > LEAST_LETTERS:
            at = int(h[k]) % len(word)
            into[utf8(word[:at] + word[at + 1 :])] += 1
    first, last = first[~struck], last[~struck]
    up, down = powers(len(a) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(LETTERS[a] * up[: len(a)], dtype=np.uint64)])
    _, at, times = np.unique(mixed((sums[last] - sums[first]) * down[first]), return_index=True, return_counts=True)
    for i, j, n in zip(first[at].tolist(), last[at].tolist(), times.tolist()):
        into[raw[i:j]] += n


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): the words of all texts."""

    def run(batches):
        held: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8") for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for part in slices(batches, "text", rows=4096, chars=4_000_000):
            ids, texts = part.column("id").to_pylist(), part.column("text").to_pylist()
            count_words(["" if i is None else i for i in ids], ["" if x is None else x for x in texts], held)
            if len(held) > HELD:
                yield out()
                held.clear()
        yield out()

    counted = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the list, code points between end marks) of the words of each length."""
    sizes = np.array([len(w) for w in words])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        code = np.frombuffer("".join(words[k] for k in at).encode("utf-32-le"), np.uint32).reshape(len(at), size)
        yield at, np.pad(code, ((0, 0), (1, 1)), constant_values=((0, 0), (1, 2))).astype(np.uint64)


def limit(b: int) -> int:
    """Longest gram for words of b and b + 1 letters."""
    return min(LONGEST, (b + 2) // 2)


def grams(code: np.ndarray, longest: int) -> dict[int, np.ndarray]:
    """Hashes of the grams of 2 to `longest` letters at each place."""
    out = {1: mixed(code + np.uint64(7))}
    for q in range(2, longest + 1):
        out[q] = mixed(out[q - 1][:, : code.shape[1] - q + 1] * BASE + code[:, q - 1 :])
    del out[1]
    return out


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, c) over all words, counted batch by batch before the shuffle."""

    def run(batches):
        for b in batches:
            found = [g.ravel() for _, code in by_length(b.column("word").to_pylist()) for g in grams(code, limit(code.shape[1] - 2)).values()]
            g, n = np.unique(np.concatenate(found) if found else np.empty(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n)], names=["gram", "c"])

    return words.select("word").mapInArrow(run, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def frequent_grams(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes and counts of the frequent grams: above a limit that leaves at most GRAMS of them."""
    counted = keep(gram_counts(words))
    total = counted.agg(F.sum("c")).first()[0] or 0
    rows = counted.where(F.col("c") > max(RARE, total // GRAMS)).toPandas()
    g, c = rows["gram"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64)
    order = np.argsort(g)
    return g[order], c[order]


def times(known: tuple[np.ndarray, np.ndarray], g: np.ndarray) -> np.ndarray:
    """Counts of grams, 0 for rare ones."""
    if not len(known[0]):
        return np.zeros(g.shape, np.int64)
    at = np.minimum(np.searchsorted(known[0], g), len(known[0]) - 1)
    return np.where(known[0][at] == g, known[1][at], 0)


def decompose(code: np.ndarray, longest: int, known) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, hash, taken) of the longest dictionary gram at each place but the last; taken if not inside an earlier one."""
    m, n = code.shape
    g = grams(code, longest)
    size, best, open_ = np.full((m, n - 1), 2), g[2].copy(), np.ones((m, n - 1), bool)
    for q in range(3, longest + 1):
        grown = open_[:, : n - q + 1] & (times(known, g[q - 1][:, : n - q + 1]) > 0)
        size[:, : n - q + 1][grown] = q
        best[:, : n - q + 1][grown] = g[q][grown]
        open_ = np.zeros((m, n - 1), bool)
        open_[:, : n - q + 1] = grown
    taken, reach = np.zeros((m, n - 1), bool), np.full(m, -1)
    for p in range(n - 1):
        end = p + size[:, p] - 1
        taken[:, p] = end > reach
        reach = np.maximum(reach, end)
    return size, best, taken


def bound(size: np.ndarray, taken: np.ndarray, longest: int) -> np.ndarray:
    """Taken grams that an edit leaves at least: those it may affect are counted for every place it can have."""
    places = taken.shape[1]
    worst = np.zeros(len(taken), np.int64)
    for i in range(1, places + 1):
        hit = taken[:, max(0, i - longest + 1) : i + 1].sum(1)
        for p in range(i + 1, min(places, i + longest - 1)):
            hit += taken[:, p] & (p + size[:, p] <= i + longest)
        worst = np.maximum(worst, hit)
    return taken.sum(1) - worst


def list_entries(code: np.ndarray, b: int, shifts: tuple[int, ...], known) -> tuple[np.ndarray, np.ndarray]:
    """(word's place, key) of the lists that words take part in: their rarest grams, as many as the bound asks for."""
    longest = limit(b)
    size, best, taken = decompose(code, longest, known)
    n_lists = taken.sum(1) - bound(size, taken, longest) + 1
    place = np.broadcast_to(np.arange(taken.shape[1]), taken.shape)
    order = np.lexsort((place, best, times(known, best), ~taken), axis=1)
    used = np.arange(taken.shape[1])[None] < n_lists[:, None]
    g, p = np.take_along_axis(best, order, 1)[used], np.take_along_axis(place, order, 1)[used]
    row = np.nonzero(used)[0]
    keys = [mixed((g * BASE + np.uint64(b)) * BASE + (p - s + 1).astype(np.uint64)) for s in shifts]
    return np.tile(row, len(shifts)), np.concatenate(keys)


def entries(words: DataFrame, known) -> DataFrame:
    """(key, word, n, longer): list entries of every word, as one of b letters and as one of b + 1."""
    sent = words.sparkSession.sparkContext.broadcast(known)

    def run(batches):
        for batch in batches:
            rows, keys, longer = [], [], []
            for at, code in by_length(batch.column("word").to_pylist()):
                letters = code.shape[1] - 2
                for b, shifts in ((letters, (0,)), (letters - 1, (0, 1))):
                    if b >= LEAST_LETTERS:
                        row, key = list_entries(code, b, shifts, sent.value)
                        rows.append(at[row]), keys.append(key), longer.append(np.full(len(key), b < letters))
            if rows:
                row = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys).view(np.int64)), batch.column("word").take(row), batch.column("n").take(row), pa.array(np.concatenate(longer))], names=["key", "word", "n", "longer"]
                )

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, longer boolean")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b), once each: words one edit apart."""
    listed = keep(entries(words, frequent_grams(words)))
    a = listed.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"))
    b = listed.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), "longer")
    met = a.join(b, "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def group(words: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of a (word, n) table."""
    words = keep(words)
    pairs = keep(near_pairs(words))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("m")).unionByName(pairs.select(F.col("b").alias("word"), F.col("a").alias("near"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("k"), F.col("near").alias("near"))).alias("best"))
    fits = -F.col("best.k") >= 2 * F.col("n")
    out = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.k")).alias("form_n")
    )
    out = keep(out)
    return out.join(roots(out), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def roots(formed: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: each round follows twice as many forms as the one before."""
    way = keep(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        on = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = keep(way.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        way = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            return way


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per word of all texts."""
    return group(vocabulary(docs, doc_id, text))
