"""One registered query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hinloom.catalog.base import Catalog, table
from hinloom.llm import alignment, ann, bpe, chat, grid_join, hamming, lines, near_dedup, negatives, packing, toxicity, urls
from hinloom.llm import token_counts as counting
from hinloom.llm.vocabularies import public_path

catalog = Catalog()


@catalog.query("op1_best_fit_packing")
def best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), public_path("byte_bpe_50k.json"))


# The rules of the query: longest match wins.
URL_RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]


@catalog.query(
    "op3_url_filters",
    """with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) as path from u),
r(v, h, t) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
    ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m as (select page_id, host, path, v, h || t as rule, row_number() over (partition by page_id order by length(h || t) desc nulls last) as n
    from p left join r on (host = h or ends_with(host, '.' || h)) and starts_with(path, t))
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from m where n = 1""",
)
def url_filters(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(table(spark, sf, "pages"), urls.rules(spark, URL_RULES))


@catalog.query(
    "op4_line_dedup",
    """with d as (select doc_id, coalesce(source, '') as site, string_split(text, chr(10)) as lines from documents),
t as (select site, count(*) as total from d group by 1),
l as (select site, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) as line from d),
b as (select site, line from l join t using (site) group by 1, 2 having count(*) - 1.5 * sqrt(count(*)) > max(total) * cast(0.005 as double)),
s as (select site, list(line) as bad from b group by 1),
k as (select doc_id, lines, list_filter(lines, lambda x: not list_contains(coalesce(bad, []), trim(x, ' ' || chr(9) || chr(13)))) as kept
    from d left join s using (site))
select doc_id, coalesce(len(lines), 0) as n_lines, coalesce(len(lines) - len(kept), 0) as n_dropped,
  case when lines is null then null else array_to_string(kept, chr(10)) end as text from k""",
)
def line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return lines.drop_boilerplate(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


@catalog.query("op9_token_counts")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return counting.count_tokens(table(spark, sf, "documents"), public_path("byte_bpe_50k.json"))


@catalog.query("op5_byte_level_bpe")
def byte_level_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    ranks = public_path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_and_decode(table(spark, sf, "documents"), ranks, public_tokenizers.PATTERN)


# Queries of the searches: the rows whose id is divisible by this.
QUERY_STRIDE = 50


@catalog.query("op6_approximate_nearest_neighbours")
def approximate_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    found = ann.nearest(rows, rows.where(F.col("id") % QUERY_STRIDE == 0), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@catalog.query(
    "op10_exact_top_k_search",
    """with c as (select vec_id, list_transform(embedding, lambda x: x > 0) as code from embeddings where len(embedding) = 64),
p as (select q.vec_id as query_id, r.vec_id, cast(len(list_filter(list_zip(q.code, r.code), lambda z: z[1] <> z[2])) as integer) as distance
    from c q join c r on q.vec_id <> r.vec_id where q.vec_id % 50 = 0),
n as (select *, row_number() over (partition by query_id order by distance, vec_id) as rank from p)
select query_id, cast(rank as integer) as rank, vec_id, distance from n where rank <= 10""",
)
def exact_top_k_search(spark: SparkSession, sf: str) -> DataFrame:
    code = hamming.sign_code(F.col("embedding"), 64)
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), code.alias("code"))
    found = hamming.nearest(rows, rows.where(F.col("id") % QUERY_STRIDE == 0), 10)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


@catalog.query(
    "op2_minhash_near_dedup",
    r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as x from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k
    from e a join e b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p where 100 * k >= 75 * (na + nb - k)),
r as (select doc_id, doc_id as c from s union select r.doc_id, l.b from r join l on r.c = l.a),
m as (select doc_id, min(c) as component_id from r group by 1)
select doc_id, cast(len(sh) as bigint) as n_shingles, component_id, doc_id = component_id as kept from s join m using (doc_id)""",
)
def minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf, "documents")).drop("text_hash")


@catalog.query("op7_chat_formatting")
def chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    return chat.reply_ordered(table(spark, sf, "conversations"))


@catalog.query("op8_toxicity")
def toxic_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf, "labels")))


@catalog.query("op11_cross_tokenizer_alignment")
def cross_tokenizer_alignment(spark: SparkSession, sf: str) -> DataFrame:
    a, b = public_path("byte_bpe_50k.json"), public_path("piece_bpe_32k.model")
    return alignment.align(table(spark, sf, "documents"), a, b)


@catalog.query(
    "op12_embedding_near_dedup",
    """with recursive e as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as v from embeddings),
g as (select vec_id, v from e where v is not null and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(v, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from g a join g b on a.vec_id <> b.vec_id and list_cosine_similarity(a.v, b.v) >= 0.9),
n as (select a as vec_id, count(*) as n_links from l group by 1),
r as (select vec_id, vec_id as c from e union select r.vec_id, l.b from r join l on r.c = l.a),
m as (select vec_id, min(c) as component_id from r group by 1)
select vec_id, coalesce(n_links, 0) as n_links, component_id, vec_id = component_id as kept from m left join n using (vec_id)""",
)
def embedding_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return grid_join.link(rows).withColumnRenamed("id", "vec_id")


# Anchors are the rows whose id is divisible by the first number; labels of ids divisible by the second one are moved on.
ANCHOR_STRIDE = 100
MOVED_STRIDE = 7


@catalog.query(
    "op13_hard_negative_mining",
    """with q as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as anchor_id, b.id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
    from q a join q b on a.id <> b.id where a.id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, id) <= 5),
w as (select p.anchor_id, positive_id, row_number() over (partition by p.anchor_id, positive_id order by score desc, id) as rank,
    id as negative_id, positive_score, score as negative_score from p join s on s.anchor_id = p.anchor_id and not same
    and 80 * positive_score <= 100 * score and 100 * score <= 100 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from w where rank <= 5""",
)
def hard_negative_mining(spark: SparkSession, sf: str) -> DataFrame:
    label = F.when(F.col("vec_id") % MOVED_STRIDE == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("vector")
    )
    return negatives.mine(rows, F.col("id") % ANCHOR_STRIDE == 0)
