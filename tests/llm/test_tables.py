"""Operators and stages over whole tables: nulls, repeats, empty tables, extra columns; joins and shards against brute force."""

import hashlib
import random
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from busloom.llm import calibrate, chat, common, components, decontaminate, jaccard, queries, ranking, shards, stats, url_lists  # noqa: E402
from busloom.session import make_session  # noqa: E402

SYLLABLES = "an er in on re st th ou ha le".split()


@pytest.fixture(scope="module")
def spark():
    s = make_session(master="local[8]", shuffle=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s


def sentence(n, rnd):
    return " ".join("".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 4))) for _ in range(n)) + "."


ITEM = "What is the largest of the inland seas, and which rivers bring it water from the mountains in the north of the country?"


def documents():
    """(doc_id, text) with good and bad prose, copies, near copies, a passage, personal data and odd rows."""
    rnd, rows = random.Random(12), []
    for i in range(160):
        rows.append((i, "\n".join(sentence(12, rnd) for _ in range(8))))
    base = rows[3][1].split(" ")
    for i in range(160, 190):
        w = list(base)
        for _ in range(i % 7):
            w[rnd.randrange(len(w))] = "edited" + str(i)
        rows.append((i, " ".join(w)))
    for i in range(190, 230):
        rows.append((i, " ".join(w + "***" for w in sentence(70, rnd).split())))
    rows += [(230 + i, rows[5][1]) for i in range(10)]
    rows += [(240, rows[8][1] + " " + ITEM + " " + rows[9][1]), (241, "\n".join(sentence(12, rnd) for _ in range(8)) + " call +1 (234) 567-8901 now or a.b@mail.example.com")]
    rows += [(242, None), (243, ""), (244, "  \n "), (245, "one"), (246, "one"), (247, "two words"), (None, sentence(80, rnd)), (None, None), (248, "x" * 300_000), (249, "long " * 60_000), (5, rows[5][1]), (5, rows[6][1])]
    return rows


def tables(spark, at, rows, empty=False):
    some = (lambda x: [] if empty else x)
    docs = some([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows])
    labels = some([(i, 0 if i is not None and 190 <= i < 230 else 1, 0) for i, _ in rows if i is None or i % 2] + [(7, None, None), (7, 1, 0), (7, 1, 1)])
    given = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": (labels, "doc_id long, quality int, toxic int"),
        "benchmark": (some([(1, ITEM), (2, None), (3, ""), (None, ITEM), (4, "tiny")]), "item_id long, text string"),
        "pages": (some([(1, "http://a.example.com/x", "<article><p>hi</p></article>"), (2, None, None), (3, "no url", ""), (3, "HTTPS://User@B.a.Example.com.:80/", "<p>x"), (None, "http://a.example.com", "y")]), "page_id long, url string, html string"),
        "conversations": (some([(1, 0, "user", "a\\b</s>"), (1, 1, "assistant", "[INST]<s>\\\\[IMG]"), (1, 1, "assistant", None), (2, None, None, None), (None, 3, "tool", "x"), (2, 5, "assistant", "")]), "conv_id long, turn long, role string, text string"),
        "embeddings": (some([(50, [0.5, 0.25], 1), (51, [0.25, 0.5], 1), (52, [0.5, 0.125], 2), (53, None, 1), (None, [0.5, None], None)]), "vec_id long, embedding array<float>, label int"),
    }
    clash = {"documents": ["node", "n", "size", "shard", "_hash", "t", "prefix", "rep", "score", "_given", "ids"], "pages": ["host", "list", "pattern", "start"], "conversations": ["content", "size"], "labels": ["label", "text"], "benchmark": ["doc_id"], "embeddings": []}
    for name, (data, schema) in given.items():
        df = spark.createDataFrame(data, schema)
        for c in clash[name]:
            df = df.withColumn(c, F.lit("other"))
        df.write.parquet(f"{at}/{name}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def filled(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("filled"), documents())


@pytest.fixture(scope="module")
def bare(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("bare"), [], empty=True)


NAMES = list(queries.QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, bare, name):
    assert queries.QUERIES[name](spark, bare).count() == (1 if name.startswith("op6") else 0)


@pytest.mark.parametrize("name", [n for n in NAMES if n[:4] in ("op1_", "op10", "op4_", "op5_", "op7_", "op8_")])
def test_a_row_for_every_document(spark, filled, name):
    out = queries.QUERIES[name](spark, filled)
    want = Counter(i for i, _ in documents())
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == want
    assert out.columns[0] == "doc_id"


def test_bounded_sample(spark):
    df = spark.range(20_000).withColumnRenamed("id", "doc_id").repartition(5)
    one, two = (common.bounded_sample(d, "doc_id", 100) for d in (df, df.coalesce(1)))
    assert len(one) == 100 and one["doc_id"].tolist() == two["doc_id"].tolist()
    assert sorted(common.bounded_sample(df.limit(150), "doc_id", 200)["doc_id"]) == sorted(r.doc_id for r in df.limit(150).collect())
    assert len(common.bounded_sample(df.limit(0), "doc_id", 5)) == 0


def test_quality_verdicts(spark, filled):
    kept = {r.doc_id: r for r in queries.QUERIES["op1_quality_rules"](spark, filled).collect()}
    assert sum(kept[i].kept for i in range(6, 160)) >= 146 and not any(kept[i].kept for i in range(190, 230))
    assert kept[243].base_failed and not kept[243].kept and kept[249].base_failed
    out = {r.doc_id: r for r in queries.QUERIES["op10_quality_classifier"](spark, filled).collect()}
    assert all(out[i].predicted == 1 for i in range(6, 160)) and not any(out[i].predicted for i in range(190, 230))
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def brute_components(rows, k, percent):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for a in range(len(rows)):
        groups[find(a)].append(a)
    least = {}
    for g in groups.values():
        ids = [rows[a][0] for a in g if rows[a][0] is not None]
        for a in g:
            least[a] = min(ids, default=None)
    return Counter((rows[a][0], len(sets[a]), least[a]) for a in range(len(rows)))


@pytest.mark.parametrize("rare,broadcast_rows", [(16, 1_000_000), (2, 1_000_000), (1, 0)])
def test_jaccard_components(spark, filled, monkeypatch, rare, broadcast_rows):
    monkeypatch.setattr(jaccard, "RARE", rare)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast_rows)
    docs = spark.read.parquet(f"{filled}/documents.parquet")
    for k, percent in ((3, 90), (5, 80)):
        got = Counter(tuple(r) for r in jaccard.apply(docs, k=k, percent=percent).collect())
        assert got == brute_components(documents(), k, percent)


def test_jaccard_chains_and_small_sets(spark, monkeypatch):
    """Chains of edits, subsets and sets of every small size, with frequent tokens throughout."""
    monkeypatch.setattr(jaccard, "RARE", 3)
    rnd = random.Random(5)
    rows, words = [], [f"w{i}" for i in range(400)]
    for base in range(4):
        text = words[base * 90 : base * 90 + 80]
        for step in range(14):
            text = list(text)
            text[step * 5] = f"e{base}_{step}"
            rows.append((len(rows), " ".join(text)))
    for size in range(1, 40):
        rows.append((len(rows), " ".join(words[:size])))
    for _ in range(40):
        rows.append((len(rows), " ".join(words[: rnd.randint(60, 90)] + words[200 : 200 + rnd.randint(0, 12)])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.apply(df).collect()) == brute_components(rows, 3, 90)


@pytest.mark.parametrize("broadcast_rows", [1_000_000, 0])
def test_jaccard_near_copies_of_repeated_rows(spark, monkeypatch, broadcast_rows):
    """Near copies that lack the first tokens of a row that is repeated."""
    monkeypatch.setattr(jaccard, "RARE", 16)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", broadcast_rows)
    rows = []
    for base in range(4):
        words = [f"w{base}_{i}" for i in range(200)]
        order = np.argsort([jaccard.token_set(" ".join(words[i : i + 3]), 3)[0] for i in range(198)])
        near = [f"e{base}_{i}" if i in order[:3] + 1 else w for i, w in enumerate(words)]
        rows += [(2 * base, " ".join(words))] * 10 + [(2 * base + 1, " ".join(near))]
    rows += [(100, " ".join(f"often{i}" for i in range(60)))] * 20  # its tokens are frequent
    want = brute_components(rows, 3, 90)
    assert want[(1, 198, 0)] == 1
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in jaccard.apply(df).collect()) == want


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 200)] + [(None, 3), (4, 4)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in parent if any(n in e and e[0] != e[1] and None not in e for e in edges)}


def test_shards(spark, filled):
    out = queries.QUERIES["op8_histogram_shards"](spark, filled).toPandas()
    rows = documents()
    assert sorted(out["size"]) == sorted(len((t or "").encode()) + 8 for _, t in rows)
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_shard_balance_and_slices(spark):
    rows = [(i, f"text {i % 50_000 // 7} " + "y" * (i % 90)) for i in range(20_000)] + [(20_000 + i, "the same") for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    narrow = common.keep(shards.with_order(docs).select("doc_id", shards.row_bytes().alias("size"), *shards.WORDS))
    cuts = shards.splitters(narrow, 24)
    assert len(cuts) == 23 and cuts == sorted(cuts)
    placed = narrow.withColumn("shard", shards.shard_of(cuts))
    out = shards.with_slots(placed, len(rows), 24, slice_rows=100).toPandas()
    size = out.groupby("shard")["size"].sum()
    assert len(size) == 24 and size.max() < 1.05 * size.mean() and size.min() > 0.95 * size.mean()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))


def test_contaminated_places(spark, filled):
    out = queries.QUERIES["op2_decontamination"](spark, filled).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(240, 1), (240, None)}
    r = next(r for r in out if r.item_id == 1)
    text = dict(documents()[:-2])[240]
    assert text[r.doc_start : r.doc_end] == ITEM.rstrip("?") and r.edits == 0


def test_blocks_of_items(spark, filled, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 60)
    out = queries.QUERIES["op2_decontamination"](spark, filled).collect()
    assert {(r.doc_id, r.item_id) for r in out} == {(240, 1), (240, None)}


def test_conversations(spark, filled):
    out = {r.conv_id: r for r in queries.QUERIES["op6_chat_format"](spark, filled).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(out) == {-1, 1, 2, None}
    assert out[1].turns_sha256 == sha("user\na\\b</s>\nassistant\n\nassistant\n[INST]<s>\\\\[IMG]\n")
    assert out[1].loss_sha256 == sha("[INST]<s>\\\\[IMG]") and out[2].n_turns == 2 and out[2].turns_sha256 == sha("\n\nassistant\n\n")
    ok = "</s>[INST] ok [/INST]"
    assert out[-1].turns_sha256 == sha(f"user\n{ok}\nassistant\n{ok}\n") and out[-1].loss_chars == len(ok)


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "look [IMG] ", None, None, None, None, None), ("image", None, "a.png", 56, 29, None, None), ("audio", None, "b.wav", None, None, 2.0, None), ("document", None, "c.pdf", None, None, None, 3), ("film", None, "d", None, None, None, None)]), (1, 1, "assistant", [("text", "a", None, None, None, None, None), ("image", None, "e", None, None, None, None), ("text", "b", None, None, None, None, None)]), (1, 2, "user", None), (1, 3, None, [])]
    done = chat.format_turns(spark.createDataFrame(rows, f"conv_id long, turn long, role string, content array<{chat.PART}>"))
    got = {r.turn: r for r in done.collect()}
    assert got[0].formatted == "<s>[INST]user[/INST]look \\[IMG] [IMG][AUD][DOC][DOC]</s>"
    assert [(a.kind, a.ref, a.tokens, got[0].formatted[a["at"] :][:5]) for a in got[0].attachments] == [("image", "a.png", 4, "[IMG]"), ("audio", "b.wav", 25, "[AUD]"), ("document", "c.pdf", 1536, "[DOC]"), ("document", "d", 0, "[DOC]")]
    assert "".join(got[1].formatted[m.start : m.stop] for m in got[1].loss) == "ab"
    back = {r.turn: r for r in chat.read_back(done).collect()}
    assert back[0].text == "look [IMG] [IMG][AUD][DOC][DOC]" and back[2].text == "" and back[1].loss == "ab"


def test_escapes_are_read_back():
    rnd = random.Random(1)
    for _ in range(2000):
        t = "".join(rnd.choice(["\\", "<s>", "</s>", "[INST]", "[/INST]", "[IMG]", "[", "s>", "a", "\n"]) for _ in range(rnd.randint(0, 9)))
        f = chat.format_turn(t, [{"text": t}])
        assert chat.read_turns("".join(f.out)) == [(t, t)]


def test_url_histories(spark):
    events = [("l", "x.com", "add", 10), ("l", "X.com", "add", 12), ("l", "x.com", "remove", 20), ("l", "x.com", "remove", 22), ("l", "x.com", "add", 30), ("l", "x.com", "remove", 30), ("l", "x.com", "add", 40), ("m", "a.x.com", "add", 15), ("m", "a.x.com", "remove", 45), ("m", "y.org", "remove", 1), (None, None, None, None)]
    rnd = random.Random(3)
    captures = [(i, rnd.choice(["http://a.x.com/q", "https://x.com", "http://b.a.x.com:8/", "http://y.org", "http://xx.com", None, "mailto:x"]), rnd.randrange(50)) for i in range(300)] + [(999, "http://x.com", None)]
    ev = spark.createDataFrame(events, "list string, pattern string, action string, at long")
    out = {r.id: r for r in url_lists.judge(spark.createDataFrame(captures, "id long, url string, fetched long"), ev, ("id",)).collect()}
    active = {"x.com": [(10, 20), (40, 99)], "a.x.com": [(15, 45)]}
    for i, url, t in captures:
        host = (url or "").split("//")[-1].split("/")[0].split(":")[0] if "//" in (url or "") else None
        want = [p for p in active if host and t is not None and (host == p or host.endswith("." + p)) and any(a <= t < b for a, b in active[p])]
        assert (out[i].pattern, out[i].n_active) == (max(want, key=len, default=None), len(want))
    assert len(out) == len(captures)


def test_no_python_in_the_list_join(spark, filled):
    plan = queries.QUERIES["op3_url_lists"](spark, filled)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def run_stages(spark, at, out):
    docs, seen = spark.read.parquet(f"{at}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, at).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        seen.append((name, docs))
    return seen


def test_pipeline_stages(spark, filled, tmp_path):
    rows = documents()
    seen = run_stages(spark, filled, tmp_path)
    ids = [Counter(r.doc_id for r in df.select("doc_id").collect()) for _, df in seen]
    columns = spark.read.parquet(f"{filled}/documents.parquet").columns
    assert all(df.columns == columns for _, df in seen[:-1])
    assert set(ids[0]) >= set(range(160)) and not set(ids[0]) & set(range(190, 230))
    kept = {i for (i, _, c), n in brute_components([r for r in rows if r[0] is not None and ids[0][r[0]]], 5, 80).items() if c == i or c is None}
    assert {i for i in ids[1] if i is not None} == kept
    assert 240 in ids[1] and 240 not in ids[2] and ids[2] + Counter([240]) == ids[1]
    assert ids[3] == ids[2] == ids[4]
    masked = seen[3][1].where("doc_id = 241").first()
    assert "<phone>" in masked.text and "<email>" in masked.text and masked.n_chars == len(masked.text)
    last = seen[-1][1]
    assert last.where("n_tokens <> size(ids)").count() == 0 and "n_tokens" in last.columns


def test_pipeline_of_nothing(spark, bare, tmp_path):
    assert [df.count() for _, df in run_stages(spark, bare, tmp_path)] == [0] * 5
    assert corpus_pipeline.run(spark, bare).count() == 0


def test_shards_part_repeated_rows(spark):
    """Rows equal in doc_id and text, nulls or not, don't keep a shard from its law."""
    rows = [(i, f"text {i}") for i in range(2000)] + [(None, None)] * 2000 + [(5, "once more")] * 1500
    out = shards.apply(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).toPandas()
    assert len(out) == len(rows)
    held = out.groupby("shard")["size"].sum()
    assert sorted(held.index) == list(range(24)) and held.max() - held.min() <= 0.06 * held.sum() / 24 + 40
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    crc = {(d, t): zlib.crc32((t or "").encode()) for d, t in rows}
    got = {(None if pd.isna(d) else int(d), c) for d, c in zip(out.doc_id, out.text_crc32)}
    assert got == {(d, c) for (d, _), c in crc.items()}


def test_quantile_cut():
    hist = np.array([[100, 3, 1], [200, 1, 0], [500, 1, 4], [900, 0, 10]], dtype=float)
    assert calibrate.quantile_cut(hist) == pytest.approx((201 + 500) / 2 * calibrate.BIN)  # five rows labelled 0, five rows below
    assert calibrate.quantile_cut(hist[3:]) is None and calibrate.quantile_cut(hist[:0]) is None


def test_pairwise_fit_against_plain_descent():
    """The Newton steps end where plain gradient descent on the same pairs ends."""
    r = np.random.default_rng(3)
    x = r.normal(0, 1, (400, len(stats.NAMES)))
    y = (x[:, 0] - 0.5 * x[:, 1] + r.normal(0, 1, 400) > 0).astype(int)
    model = ranking.learn(x, y, pairs=3000)
    good, bad = model.features(x[y == 1]), model.features(x[y == 0])
    pick = np.random.default_rng(11)
    d = good[pick.integers(0, len(good), 3000)] - bad[pick.integers(0, len(bad), 3000)]
    w = np.zeros(d.shape[1])
    rate = 1 / (np.linalg.eigvalsh(d.T @ d / 4 / len(d))[-1] + ranking.L2)
    for _ in range(30_000):
        w -= rate * (d.T @ (common.sigmoid(d @ w) - 1) / len(d) + ranking.L2 * w)
    assert np.abs(w - model.weights).max() < 0.02


def test_held_out_labels_change_no_score(spark, filled):
    """held_out is crc32 of the id as text, mod 5; turning those labels round leaves every score as it is."""
    docs, labels = (spark.read.parquet(f"{filled}/{t}.parquet").select(*c) for t, c in (("documents", ("doc_id", "text")), ("labels", ("doc_id", "quality"))))
    measured = ranking.measure(docs)
    turned = labels.withColumn("quality", F.when(common.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (ranking.apply(measured, ranking.fit(measured, rows)).toPandas() for rows in (labels, turned))
    key = ["doc_id", "score"]
    assert a.sort_values(key)[key].reset_index(drop=True).equals(b.sort_values(key)[key].reset_index(drop=True))
    assert all(h == (not pd.isna(d) and zlib.crc32(str(int(d)).encode()) % 5 == 0) for d, h in zip(a.doc_id, a.held_out))
