"""N-gram Jaccard join by token-combination prefixes.

A document's set holds its distinct word shingles. Two sets of sizes m and n link if 100 * shared >= PERCENT * union, so each
may miss at most d = n - ceil(n * PERCENT / 100) tokens of its own. Tokens are put in one order for all: rare ones by hash,
then frequent ones by hash. A prefix of d + 1 rare tokens shares one with any partner. Where a set has too few rare tokens its
prefix is extended: frequent tokens fall in classes by hash, a class of c tokens gives all its pairs and counts c - 1, and the
prefix ends when rare tokens and counts reach d + 1; whichever d tokens a partner lacks, a rare token or a pair is shared.
So rare tokens are indexed alone and frequent ones in pairs.

  1. Equal sets are one class. Of each the head is stored, twice as many tokens by hash as a prefix needs; counts over all
     heads show which tokens are frequent (above RARE).
  2. Heads with d + 1 rare tokens give the prefix at once. The others' sets are looked at again, whole: all their tokens are
     counted too, and they get extended prefixes.
  3. Sets that share rare tokens are paired if their sizes and the number of them leave a link possible. Sets that share a pair
     of frequent tokens meet in a star: each is paired with the bucket's hub alone.
  4. The stars, and one pair of each set with a rare token, are verified on whole sets. What they link is one component.
  5. The other pairs between components are verified; so are members of one hub's buckets in different components, unless sizes, or what each shares with the hub, rule a link out. No link between components is lost, and none within one is
     needed.

Nothing is collected but frequent tokens, and those only up to BROADCAST_ROWS; beyond that they are joined. A bucket of a rare
token is bounded and gathered; those of frequent pairs are joined, so adaptive execution can split a hot one.

Defined cases: null and empty texts have size 0 and link with nothing; below K words the whole sequence is the one token;
repeated rows share a component; a row with a null doc_id links with equal sets only and gets the component's smallest id, null
if there is none; other columns are not read. Tokens and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from busloom.llm.common import keep, over_texts, utf8
from busloom.llm.components import components

K, PERCENT = 3, 90
#: A token in more prefixes than this is frequent; tokens that a class of frequent tokens has for each 16 of a set.
RARE, CLASS_TOKENS = 64, 16
#: Rows up to which the smaller side of a filter is broadcast.
BROADCAST_ROWS = 1_000_000

BASE, ODD, MORE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Bytes hashed at once, and characters of texts whose sets are held at once: what a worker needs doesn't follow the length of texts.
PIECE, SLICE_CHARS = 1 << 17, 400_000
#: Bytes of an Arrow batch of texts or sets on its way to a worker.
BATCH_BYTES = 8 << 20
LETTERS = np.random.default_rng(99).integers(1, 1 << 63, 256, dtype=np.uint64)
POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * ODD
    x = (x ^ (x >> np.uint64(27))) * MORE
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2 ** 64."""
    if len(POWERS[0]) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        back = np.uint64(pow(int(BASE), -1, 1 << 64))
        for k, b in enumerate((BASE, back)):
            POWERS[k] = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, b, np.uint64)]))
    return POWERS[0], POWERS[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, A-Z as a-z; long texts in pieces that end between words."""
    out, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + PIECE)
        while stop < len(raw) and not (raw[stop] == 32 or 9 <= raw[stop] <= 13):
            stop += 1
        a = np.frombuffer(raw[at:stop].lower(), np.uint8)
        full = ~((a == 32) | ((a >= 9) & (a <= 13)))
        edge = np.flatnonzero(np.diff(np.concatenate([[False], full, [False]]).astype(np.int8)))
        first, last = edge[::2], edge[1::2]
        up, down = powers(len(a) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(LETTERS[a] * up[: len(a)], dtype=np.uint64)])
        out.append(mixed((sums[last] - sums[first]) * down[first]))
        at = stop
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def token_set(text: str, k: int) -> np.ndarray:
    """Sorted distinct hashes (signed) of the k-word shingles; of the whole sequence if it is shorter."""
    w = word_hashes(utf8(text))
    if not len(w):
        return np.empty(0, np.int64)
    size = min(k, len(w))
    code = np.full(len(w) - size + 1, np.uint64(size))
    for j in range(size):
        code = mixed(code * BASE + w[j : len(w) - size + 1 + j])
    return np.unique(code.view(np.int64))


def node_of(t: np.ndarray) -> int:
    """The set's own hash."""
    return int((mixed(t.view(np.uint64)).sum(dtype=np.uint64) ^ mixed(np.array([len(t)], np.uint64))[0]).view(np.int64))


def may_lose(n: int, percent: int) -> int:
    return n - -(-n * percent // 100)


def partnered(n: int, percent: int) -> bool:
    """Whether a set of n tokens can link with a different set at all."""
    return 100 * n >= percent * (n + 1)


def bounded_batches(df: DataFrame) -> None:
    """From now on Arrow batches of the session hold BATCH_BYTES at most, besides one row of any length; a limit set by the user stays."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(name) == "67108864b":  # Spark's own
        conf.set(name, str(BATCH_BYTES))


def sketches(docs: DataFrame, doc_id: str, text: str, k: int, percent: int) -> DataFrame:
    """(doc, n, node, head): head holds the first 2 (d + 1) tokens by hash."""

    def run(texts):
        sets = [token_set(x, k) for x in texts]
        return {
            "n": list(map(len, sets)),
            "node": [node_of(t) if len(t) else None for t in sets],
            "head": [t[: 2 * may_lose(len(t), percent) + 2] if partnered(len(t), percent) and len(t) else [] for t in sets],
        }

    given = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text"))
    return over_texts(given, run, "n int, node long, head array<long>", ("doc",), chars=SLICE_CHARS)


def only(df: DataFrame, ids: DataFrame, key, how: str = "left_semi") -> DataFrame:
    """Rows of df whose key is in ids (how: left_semi) or isn't (left_anti); ids are broadcast if counted few."""
    few = ids.count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, how)


def sets_of(docs: DataFrame, doc_id: str, text: str, k: int, reps: DataFrame) -> DataFrame:
    """(node, n, t) of the documents that stand for their class; only their texts are read into sets."""
    given = only(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")), reps.select(F.col("rep").alias("doc")).distinct(), "doc")

    def run(texts):
        sets = [token_set(x, k) for x in texts]
        return {"node": [node_of(t) if len(t) else None for t in sets], "n": list(map(len, sets)), "t": sets}

    made = over_texts(given, run, "node long, n int, t array<long>", ("doc",), chars=SLICE_CHARS).drop("doc")
    return only(made, reps.select("node").distinct(), "node")


def extended(t: np.ndarray, often: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rare tokens alone, pair signatures, frequent tokens if there are pairs) of a set whose frequent tokens are marked."""
    n, need = len(t), may_lose(len(t), percent) + 1
    rare, freq = t[~often], t[often]
    if len(rare) >= need or not partnered(n, percent):
        return rare[:need], t[:0], t[:0]
    level = lambda m: m.bit_length() - 1
    pairs: list[np.ndarray] = []
    for lv in sorted({level(max(1, n * percent // 100)), level(max(1, -(-n * percent // 100))), level(n)}):
        classes = max(1, (1 << lv) // CLASS_TOKENS)
        of = (mixed(freq.view(np.uint64)) % np.uint64(classes)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        start = np.concatenate([[True], of[order][1:] != of[order][:-1]])
        later = np.empty(len(freq), bool)
        later[order] = ~start
        counted = len(rare) + np.cumsum(later)
        stop = int(np.searchsorted(counted, need)) + 1
        part, of = freq[:stop].view(np.uint64), of[:stop]
        for c in np.unique(of[later[:stop]]):
            own = part[of == c]
            a, b = np.triu_indices(len(own), 1)
            pairs.append(mixed(mixed(own[a] + np.uint64(lv)) * BASE + own[b]).view(np.int64))
    return rare, np.concatenate(pairs) if pairs else t[:0], freq


def sent_tokens(frequent: DataFrame):
    """The frequent tokens as a broadcast sorted array, None if they are too many."""
    if frequent.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        return None
    return frequent.sparkSession.sparkContext.broadcast(np.sort(frequent.select("tok").toPandas()["tok"].to_numpy(np.int64)))


def marked(known: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Which tokens of t are among the known."""
    return known[np.minimum(np.searchsorted(known, t), len(known) - 1)] == t if len(known) else np.zeros(len(t), bool)


def without_frequent(heads: DataFrame, frequent: DataFrame) -> DataFrame:
    """(node, n, head) to (node, n, rare): the head's rare tokens, in order."""
    sent = sent_tokens(frequent)
    if sent is None:
        heads = heads.select("node", "n", "head").dropDuplicates(["node"])  # repeated rows would repeat their tokens
        left = heads.select("node", F.explode("head").alias("tok")).join(frequent, "tok", "left_anti").groupBy("node").agg(F.array_sort(F.collect_list("tok")).alias("rare"))
        return heads.select("node", "n").join(left, "node", "left").select("node", "n", F.coalesce("rare", F.array().cast("array<bigint>")).alias("rare"))

    def run(batches):
        for b in batches:
            heads_ = [np.asarray(h.values) for h in b.column("head")]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), pa.array([h[~marked(sent.value, h)] for h in heads_], pa.list_(pa.int64()))], names=["node", "n", "rare"])

    return heads.select("node", "n", "head").mapInArrow(run, "node long, n int, rare array<long>")


SIGNED = "rare array<long>, pairs array<long>, freq array<long>"


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, percent: int, reps: DataFrame, frequent: DataFrame) -> DataFrame:
    """(node, n, rare, pairs, freq) of whole sets; frequent tokens come as a broadcast array, or by a join if they are too many."""
    sent = sent_tokens(frequent)
    if sent is not None:

        def run(texts):
            sets = [token_set(x, k) for x in texts]
            rare, pairs, freq = zip(*(extended(t, marked(sent.value, t), percent) for t in sets))
            return {"node": [node_of(t) if len(t) else None for t in sets], "n": list(map(len, sets)), "rare": rare, "pairs": pairs, "freq": freq}

        given = only(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")), reps.select(F.col("rep").alias("doc")).distinct(), "doc")
        return only(over_texts(given, run, f"node long, n int, {SIGNED}", ("doc",), chars=SLICE_CHARS).drop("doc"), reps.select("node").distinct(), "node")

    tokens = sets_of(docs, doc_id, text, k, reps).dropDuplicates(["node"]).select("node", "n", F.explode("t").alias("tok"))
    marks = tokens.join(frequent.withColumn("often", F.lit(True)), "tok", "left").groupBy("node", "n").agg(F.array_sort(F.collect_list(F.struct("tok", F.col("often").isNotNull().alias("often")))).alias("m"))

    def run_joined(batches):
        for b in batches:
            made = [extended(np.array([x["tok"] for x in m], np.int64), np.array([x["often"] for x in m], bool), percent) for m in b.column("m").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("n"), *(pa.array(x, pa.list_(pa.int64())) for x in zip(*made))], names=["node", "n", "rare", "pairs", "freq"])

    return marks.mapInArrow(run_joined, f"node long, n int, {SIGNED}")


def reaches(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether so many shared tokens link sets of sizes n and m."""
    return 100 * shared >= percent * (n + m - shared)


def renamed(df: DataFrame, end: str) -> DataFrame:
    return df.toDF(*(f"{c}_{end}" for c in df.columns))


def overlaps(pairs: DataFrame, docs: DataFrame, doc_id: str, text: str, k: int, reps: DataFrame, freq: DataFrame | None = None) -> DataFrame:
    """(a, b, n_a, n_b, shared) of each pair by its whole sets; with freq (node, freq) also what a's frequent tokens share with b."""
    nodes = keep(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = sets_of(docs, doc_id, text, k, only(reps, nodes, "node"))
    met = pairs.join(renamed(sets, "a"), F.col("a") == F.col("node_a")).join(renamed(sets, "b"), F.col("b") == F.col("node_b"))
    out = ["a", "b", "n_a", "n_b", F.size(F.array_intersect("t_a", "t_b")).alias("shared")]
    if freq is not None:
        met = met.join(freq.select(F.col("node").alias("a"), "freq"), "a", "left")
        out.append(F.size(F.array_intersect(F.coalesce("freq", F.array().cast("array<bigint>")), "t_b")).alias("often"))
    return met.select(*out)


def paired_by_rare(single: DataFrame, percent: int) -> DataFrame:
    """(a, b): sets that share rare tokens enough.

    A bucket has at most 2 * RARE members, RARE of heads and RARE of whole sets. All rare tokens of either up to the nearer end
    of the two prefixes are known, so the set that ends first may have only so many of its own that b lacks.
    """
    bucket = single.select("node", "n", "r", "e", F.explode("rare").alias("tok")).groupBy("tok").agg(F.collect_list(F.struct("node", "n")).alias("m")).where(F.size("m") > 1)
    fits = lambda x: F.filter("m", lambda y: (x["node"] < y["node"]) & reaches(F.least(x["n"], y["n"]), x["n"], y["n"], percent))
    both = F.flatten(F.transform("m", lambda x: F.transform(fits(x), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    met = bucket.select(F.explode(both).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("c"))
    ends = single.select("node", "n", "r", "e").dropDuplicates(["node"])
    met = met.join(renamed(ends, "a"), F.col("a") == F.col("node_a")).join(renamed(ends, "b"), F.col("b") == F.col("node_b"))
    apart = lambda x, y: (F.col(f"r_{x}") - F.col("c")) * (100 + percent) <= F.col(f"n_{x}") * 100 - F.col(f"n_{y}") * percent
    return met.where(((F.col("e_a") > F.col("e_b")) | apart("a", "b")) & ((F.col("e_b") > F.col("e_a")) | apart("b", "a"))).select("a", "b")


def links(docs: DataFrame, sketched: DataFrame, doc_id: str, text: str, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(classes, components of their nodes)."""
    classes = keep(sketched.where("node is not null").groupBy("node").agg(F.min("doc").alias("rep"), F.first("n").alias("n")))
    reps = classes.select("node", "rep").where("rep is not null")
    heads = only(sketched.where(F.size("head") > 0).withColumnRenamed("doc", "rep"), reps, ["rep", "node"])
    many = lambda tok: tok.groupBy("tok").count().where(F.col("count") > RARE).select("tok")
    need = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    deep_in = lambda f: keep(only(reps, keep(without_frequent(heads, f).where(F.size("rare") < need).select("node").distinct()), "node"))

    first = keep(many(heads.select(F.explode("head").alias("tok"))))
    deep, known = deep_in(first), -1
    while True:  # until every token of a set looked at whole is counted; rarely more than twice
        frequent = keep(first.unionByName(many(sets_of(docs, doc_id, text, k, deep).select(F.explode("t").alias("tok")))).distinct())
        known, deep = deep.count(), deep_in(frequent)
        if deep.count() == known:
            break
    signed = keep(signatures(docs, doc_id, text, k, percent, deep, frequent))

    # rare tokens: few sets hold one
    shallow = without_frequent(heads, frequent).where(F.size("rare") >= need).select("node", "n", F.slice("rare", F.lit(1), need).alias("rare"))
    end = F.when(F.size("pairs") > 0, F.lit((1 << 63) - 1)).otherwise(F.element_at("rare", -1))
    single = shallow.withColumn("pairs", F.array()).unionByName(signed.select("node", "n", "rare", "pairs")).where(F.size("rare") > 0)
    single = single.select("node", "n", F.size("rare").alias("r"), end.alias("e"), "rare")
    by_rare = keep(paired_by_rare(single, percent))

    # pairs of frequent tokens: each member with its bucket's hub
    member = keep(signed.where(F.size("pairs") > 0).select("node", "n", F.size("freq").alias("f"), F.explode("pairs").alias("sig")).distinct())
    hubs = member.groupBy("sig").agg(F.count("*").alias("c"), F.min(F.struct((F.col("n") - F.col("f")).alias("rest"), "node", "n")).alias("hub")).where("c > 1").select("sig", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    bucket = keep(member.join(hubs, "sig"))
    star = bucket.where((F.col("node") != F.col("hub")) & reaches(F.least("n", "hub_n"), F.col("n"), F.col("hub_n"), percent)).select(F.col("node").alias("a"), F.col("hub").alias("b"))

    # verified first: the stars, and each set with the smallest it shares rare tokens with; what they link is one component
    nearest = by_rare.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("b"))
    tried = keep(overlaps(keep(star.unionByName(nearest).distinct()), docs, doc_id, text, k, reps, signed.select("node", "freq")))
    linked = lambda df: df.where(reaches(F.col("shared"), F.col("n_a"), F.col("n_b"), percent)).select("a", "b")
    edges = linked(tried)
    found = keep(components(edges))

    # what is left between components
    in_one = lambda df, c: df.join(found.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}")), c, "left").withColumn(f"c_{c}", F.coalesce(f"c_{c}", c))
    apart = in_one(in_one(by_rare, "a"), "b").where("c_a <> c_b").select("a", "b")
    # sets that share a signature share its hub: members meet once for each hub, not for each signature
    own = bucket.select("hub", "node", "n", "f").distinct().join(found, "node", "left").join(tried.select(F.col("a").alias("node"), F.col("b").alias("hub"), "often"), ["node", "hub"], "left")
    own = own.select("hub", "node", "n", "f", F.coalesce("component", "node").alias("c"), F.when(F.col("node") == F.col("hub"), F.col("f")).otherwise(F.col("often")).alias("o"))
    torn = own.groupBy("hub").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("hub")
    own = keep(own.join(torn, "hub"))
    bound = F.least(F.least("o_a", "o_b") + F.least(F.col("f_a") - F.col("o_a"), F.col("f_b") - F.col("o_b")), F.least("f_a", "f_b"))
    bound = F.when(F.col("o_a").isNotNull() & F.col("o_b").isNotNull(), bound).otherwise(F.least("f_a", "f_b"))
    rest = renamed(own, "a").join(renamed(own, "b"), (F.col("hub_a") == F.col("hub_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("c_a") != F.col("c_b")) & reaches(bound, F.col("n_a"), F.col("n_b"), percent))
    rest = rest.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).unionByName(apart).distinct()
    rest = keep(rest.join(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        more = linked(overlaps(rest, docs, doc_id, text, k, reps))
        found = components(edges.unionByName(more))
    return classes, found


def apply(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every row."""
    bounded_batches(docs)
    sketched = keep(sketches(docs, doc_id, text, k, percent))
    classes, found = links(docs, sketched, doc_id, text, k, percent)
    named = classes.select("node", "rep").join(found, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("c"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    placed = named.join(least, "c").select("node", "component_id")
    out = sketched.select("doc", "n", "node").join(placed, "node", "left")
    return out.select(F.col("doc").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K, percent: int = PERCENT) -> DataFrame:
    """One row of each component, that of the smallest id, with all columns; of repeated rows of one id and text one.

    Rows without an id can't be told apart and all stay.
    """
    placed = keep(apply(docs, doc_id, text, k, percent))
    out = only(docs, keep(placed.where(F.col("component_id") < F.col(doc_id)).select(doc_id).distinct()), doc_id, "left_anti")
    again = keep(placed.groupBy(doc_id).count().where(F.col(doc_id).isNotNull() & (F.col("count") > 1)).select(doc_id))
    if again.isEmpty():
        return out
    return only(out, again, doc_id, "left_anti").unionByName(only(out, again, doc_id).dropDuplicates([doc_id, text]))
