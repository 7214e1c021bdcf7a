"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from busloom.llm import bpe, chat, decontaminate, html_text, jaccard, kronecker, pii, quality_rules, ranking, shards, toxicity, url_lists, variants

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_quality_rules")
def op1(spark, sf_dir):
    out = quality_rules.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@query("op10_quality_classifier")
def op10(spark, sf_dir):
    measured = ranking.measure(table(spark, sf_dir, "documents"))
    return ranking.apply(measured, ranking.fit(measured, table(spark, sf_dir, "labels")))


@query("op4_bpe")
def op4(spark, sf_dir):
    import public_tokenizers

    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def list_history(pages):
    """A dated list over the hosts of the pages and the names above them: per name additions and removals drawn from its md5."""
    hosts = pages.select(url_lists.host_of("url").alias("host")).where("host is not null").distinct()
    names = hosts.select(F.explode(url_lists.suffixes(F.col("host"))).alias("pattern")).distinct()
    v = F.conv(F.substring(F.md5("pattern"), 1, 4), 16, 10).cast("long")
    day = lambda n: F.lit(FIRST_DAY) + n * 86400
    start, length = v % 300, 1 + F.floor(v / 300) % 90
    entries = F.array(
        F.struct(F.lit("add").alias("action"), day(start).alias("at")),
        F.struct(F.lit("remove").alias("action"), day(start + length).alias("at")),
        F.struct(F.when(v % 2 == 0, F.lit("add")).alias("action"), day(start + length + 30 + v % 7).alias("at")),
    )
    listed = names.where(v % 3 != 0).select("pattern", F.when(v % 5 == 0, F.lit("spam")).otherwise("adverts").alias("list"), F.explode(entries).alias("e"))
    return listed.select("list", "pattern", "e.action", "e.at").where("action is not null")


#: 2024-01-01 in seconds; fetches follow through that year.
FIRST_DAY = 1704067200

URL_LIST_SQL = r"""
with captures as (
  select page_id, url, 1704067200 + (page_id * 7919 % 366) * 86400 + page_id % 86400 as fetched,
         nullif(rtrim(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1), '.'), '') as host
  from pages),
parts as (select distinct host, string_split(host, '.') as l from captures where host is not null),
names as (select host, array_to_string(l[k:], '.') as pattern from (select host, l, unnest(range(1, len(l) + 1)) as k from parts)),
draws as (select pattern, ('0x' || substr(md5(pattern), 1, 4))::bigint as v from (select distinct pattern from names)),
listed as (select pattern, case when v % 5 = 0 then 'spam' else 'adverts' end as list, v,
                  1704067200 + (v % 300) * 86400 as a, 1704067200 + (v % 300 + 1 + (v // 300) % 90) * 86400 as b from draws where v % 3 <> 0),
valid as (select list, pattern, a as start, b as stop from listed
          union all select list, pattern, b + (30 + v % 7) * 86400, null from listed where v % 2 = 0),
hits as (select c.page_id, v.list, v.pattern from captures c join names n using (host) join valid v on v.pattern = n.pattern
         and c.fetched >= v.start and (v.stop is null or c.fetched < v.stop)),
best as (select page_id, count(*) as n_active, min({'far': -length(pattern), 'list': list, 'pattern': pattern}) as b from hits group by page_id)
select c.page_id, c.url, c.fetched, c.host, b.list, b.pattern, coalesce(n_active, 0) as n_active, b.pattern is not null as listed
from captures c left join (select page_id, n_active, b.list as list, b.pattern as pattern from best) b using (page_id)
"""


@query("op3_url_lists", URL_LIST_SQL)
def op3(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    fetched = F.lit(FIRST_DAY) + (F.col("page_id") * 7919 % 366) * 86400 + F.col("page_id") % 86400
    return url_lists.judge(pages.withColumn("fetched", fetched), list_history(pages), ("page_id", "url", "fetched"))


@query("op6_chat_format")
def op6(spark, sf_dir):
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.digests(chat.read_back(chat.format_turns(turns.withColumn("content", chat.as_text_part()))))


@query("op8_histogram_shards")
def op8(spark, sf_dir):
    return shards.apply(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query("op9_main_text")
def op9(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


@query("op7_personal_data")
def op7(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return pii.apply(docs, pii.fit(docs))


@query("op2_decontamination")
def op2(spark, sf_dir):
    return decontaminate.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_ngram_jaccard")
def op5(spark, sf_dir):
    return jaccard.apply(table(spark, sf_dir, "documents"))


#: Integer components, scores of all pairs with an anchor, then positives and bounded negatives.
HARD_NEGATIVE_SQL = """
with good as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, r.vec_id as id, a.label = r.label as same,
         cast(coalesce(list_sum(list_transform(list_zip(a.v, r.v), lambda z: coalesce(z[1] * z[2], 0))), 0) as bigint) as score
  from good a join good r on a.vec_id <> r.vec_id where a.vec_id % 50 = 0),
positives as (
  select anchor_id, id as positive_id, score as positive_score from scores where same
  qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
ranked as (
  select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id) as rank,
         id as negative_id, positive_score, score as negative_score
  from positives join scores using (anchor_id)
  where not same and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from ranked where rank <= 3
"""


@query("op12_hard_negatives", HARD_NEGATIVE_SQL)
def op12(spark, sf_dir):
    return kronecker.mine(table(spark, sf_dir, "embeddings"))


@query("op13_toxicity")
def op13(spark, sf_dir):
    out = toxicity.apply(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"), shown.alias("spans"))


@query("op11_spelling_variants")
def op11(spark, sf_dir):
    return variants.apply(table(spark, sf_dir, "documents"))
