"""The registered queries of this subpackage and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelfolio.llm import chattree, hnsw, jaccard, mixing, packing, phrases, quality, secretscan, spelling, topk, toxicity, warc, whitening
from panelfolio.llm.common import new_folder, stage, table

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(statement: str | None = None):
    def register(fn):
        REGISTRY[fn.__name__] = fn
        if statement:
            STATEMENTS[fn.__name__] = statement
        return fn

    return register


@query("""
with k as (select doc_id, source, text, coalesce(cast(doc_id as varchar), md5(coalesce(text, ''))) as key from documents),
c as (select source, count(*) as n, sqrt(count(*)) as weight from documents group by source),
r as (select source, n, weight * (select sum(n) from c) / (select sum(weight) from c) / n as rate from c),
s as (select greatest(1, ceil(round(sum(n * rate)) / 5000)) as shards from r),
drawn as (select k.*, r.rate, cast(ceil(rate + sqrt(rate) * 12 + 24) as int) as terms,
  (cast('0x' || substr(md5('7|n|1|' || key), 1, 13) as bigint) + 0.5) / 4503599627370496.0 as u
  from k join r on k.source is not distinct from r.source),
t as (select key, source, u, j, exp(-rate + j * ln(rate) - lgamma(j + 1)) as p from drawn, unnest(range(0, terms)) as g(j)),
cum as (select key, source, u, sum(p) over (partition by key, source order by j) as c from t),
counted as (select key, source, count(*) filter (u >= c) as copies from cum group by all),
x as (select key, source, unnest(range(0, copies)) as replica from counted where copies > 0),
y as (select *, cast('0x' || substr(md5('7|s|' || replica || '|' || key), 1, 13) as bigint) as shuffle_key from x)
select d.doc_id, d.source, d.text, round(d.rate, 9) as rate, cast(replica as int) as replica, shuffle_key,
  cast(floor(shuffle_key / 4503599627370496.0 * (select shards from s)) as int) as shard
from y join drawn d on y.key = d.key and y.source is not distinct from d.source
""")
def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources tempered to the square root of their rows, at the corpus's own size."""
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mixing.tempered(docs, 0.5), seed=7)
    return mixed.select("doc_id", "source", F.round("rate", 9).alias("rate"), "replica", "shuffle_key", "shard", "text")


@query("""
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify rank <= 10
""")
def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, scale=1024)


@query()
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")  # the vocabulary of byte_bpe_50k.json as ranks
    return packing.pack_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, capacity=2048)


def _crc(modulus: int):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus, F.lit(0))


def _decided(scored: DataFrame, held: int, modulus: int) -> DataFrame:
    return scored.select("doc_id", (_crc(modulus) == held).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query()
def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), _crc(4) != 2)
    return _decided(quality.score(docs, model), 2, 4)


@query()
def op10_kneser_ney_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), _crc(3) != 1)
    return _decided(toxicity.score(docs, model), 1, 3)


def _matches(kind: int, pattern: str, group: int, least: str) -> str:
    """Matches with their code point offsets, from the parts between them."""
    q = pattern.replace("'", "''")
    return f"""select doc_id, {kind} as kind, start, start + length(hit) as stop, val from (
  select doc_id, hits[i] as hit, vals[i] as val, cast(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) as bigint) as start
  from (select *, unnest(range(1, len(hits) + 1)) as i from (
    select doc_id, regexp_split_to_array(text, '{q}') as gaps, regexp_extract_all(text, '{q}', 0) as hits, regexp_extract_all(text, '{q}', {group}) as vals from dd where regexp_matches(text, '{q}'))))
  where {least}"""


_SIZE = secretscan.SIZE
_CODES = f"list_transform(string_split(token, ''), lambda c: instr('{secretscan.ALPHABET}', c))"


@query(f"""
with d as (select row_number() over () as r, doc_id as id, coalesce(text, '') as text from documents),
dd as (select r as doc_id, text from d),
base as ({_matches(0, secretscan.ASSIGN, 2, "length(val) >= 6")}
  union all {_matches(1, secretscan.ACCESS, 0, "length(hit) >= 20")}
  union all {_matches(2, secretscan.HEX, 0, "length(hit) >= 24")}),
h as (select sha256(cast(i as varchar)) as h from range(0, {secretscan.RANDOM_SAMPLE}) g(i)),
tokens as (select true as random, unnest([substr(h, 1, 32), replace(to_base64(unhex(h)), '=', ''), upper(substr(h, 1, 20)),
    substr(upper(regexp_replace(to_base64(unhex(h)), '[+/=]', '', 'g')), 1, 20)]) as token from h
  union all select true, val from base
  union all select false, unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z_]{{3,}}', 0)) from (select text from (select distinct text from d) order by md5(text) limit {secretscan.SAMPLE})),
codes as (select random, {_CODES} as c from tokens),
moves as (select random, c[j - 1] * {_SIZE} + c[j] as code from codes, unnest(range(2, len(c) + 1)) as g(j)),
counts as (select code, count(*) filter (random) as r, count(*) filter (not random) as o from moves group by code),
filled as (select i as code, coalesce(r, 0) as r, coalesce(o, 0) as o from range(0, {_SIZE * _SIZE}) g(i) left join counts on code = i),
totals as (select code // {_SIZE} as previous, sum(r) as tr, sum(o) as tot from filled group by 1),
ratios as (select code, cast(round(ln(((r + 0.5) / (tr + {0.5 * _SIZE})) / ((o + 0.5) / (tot + {0.5 * _SIZE}))) * 1000) as bigint) as v from filled join totals on previous = code // {_SIZE}),
runs as ({_matches(3, secretscan.RUN + "{" + str(secretscan.LEAST) + ",}", 0, "true")}),
steps as (select doc_id, start, stop, c[j - 1] * {_SIZE} + c[j] as code from (select doc_id, start, stop, {_CODES.replace("token", "val")} as c from runs), unnest(range(2, len(c) + 1)) as g(j)),
likely as (select doc_id, 3 as kind, start, stop from steps join ratios using (code) group by doc_id, start, stop having sum(v) >= {secretscan.THRESHOLD} * (stop - start - 1)),
more as (select * from likely l where not exists (select 1 from base b where b.doc_id = l.doc_id and b.start < l.stop and l.start < b.stop)),
spans as (select doc_id, kind, start, stop from base union all select doc_id, kind, start, stop from more),
said as (select doc_id, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as k, count(*) filter (kind = 2) as x,
  string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) as s,
  string_agg(['assign', 'access', 'hex', 'markov'][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop) filter (kind < 3) as b from spans group by doc_id)
select d.id as doc_id, coalesce(a, 0) as n_assign, coalesce(k, 0) as n_access, coalesce(x, 0) as n_hex, sha256(coalesce(b, '')) as base_sha256, coalesce(s, '') as spans
from d left join said on said.doc_id = d.r
""")
def op7_markov_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secretscan.scan(docs, secretscan.train(secretscan.samples(docs)))
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == secretscan.KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(secretscan.written(F.col("base_spans")), 256).alias("base_sha256"),
                        secretscan.written(F.col("spans")).alias("spans"))


@query("""
with more as (select * from (values (-1, 0, 'user'), (-1, 1, 'assistant')) v(conv_id, turn, role)),
t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select conv_id, turn, role, '<|im_end|><|im_start|>assistant ok' from more),
f as (select *, length('<|im_start|>' || '<|im_end|>') + 2 + length(role) + length(text) + len(regexp_extract_all(role, '[\\\\\n]'))
  + len(regexp_extract_all(role, '<\\\\*[|]')) + len(regexp_extract_all(text, '<\\\\*[|]')) as chars from t),
g as (select conv_id, count(*) as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text) as said,
  coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '') as loss, sum(chars) as chars from f group by conv_id)
select cast(conv_id as bigint) as conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, cast(chars as bigint) as formatted_chars from g
""")
def op8_chat_prefix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    said = "<|im_end|><|im_start|>assistant ok"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return chattree.read_back(chattree.build(turns, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)


_GROUPS = ", ".join(f"substr(h, {1 + 5 * i}, 5)" for i in range(8))


@query(f"""
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, upper(sha1(html)) as h from p),
g as (select *, [cast('0x' || x as bigint) for x in [{_GROUPS}]] as groups from s),
d as (select page_id, payload_bytes, array_to_string(list_transform(groups, lambda v:
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 15) & 31) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 10) & 31) + 1] ||
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((v >> 5) & 31) + 1] || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(v & 31) + 1]), '') as payload_digest from g),
f as (select *, min(page_id) over (partition by payload_digest) as first_id from d)
select page_id, payload_bytes, payload_digest, case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to, true as verified from f
""")
def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives are written to the shared folder, read back once, and their revisits resolved."""
    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path, least_bytes=0)
    headers = stage(warc.read_headers(spark, path), "warc-headers")
    return warc.resolve(headers).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


@query("""
with recursive w as (select row_number() over () as r, doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda x: x <> '') as t from documents),
s as (select r, doc_id, list_sort(list_distinct(case when len(t) = 0 then [] when len(t) < 5 then [array_to_string(t, ' ')]
  else list_transform(range(1, len(t) - 3), lambda i: array_to_string(t[i:i + 4], ' ')) end)) as t from w),
n as (select row_number() over () as node, t, len(t) as size, count(*) as copies, min(doc_id) as first_id, list(doc_id) as ids from s group by t),
e as (select node, size, md5(unnest(t)) as x from n),
p as (select a.node as a, b.node as b from e a join e b on a.x = b.x and a.node <> b.node and 5 * least(a.size, b.size) >= 4 * greatest(a.size, b.size)
  group by a.node, b.node, a.size, b.size having 5 * count(*) >= 4 * (a.size + b.size - count(*))),
reach as (select node, node as other from n union select reach.node, p.b from reach join p on p.a = reach.other),
c as (select reach.node, min(m.first_id) as class_id from reach join n m on m.node = reach.other group by reach.node),
l as (select p.a as node, sum(m.copies) as links, count(*) as partners from p join n m on m.node = p.b group by p.a)
select unnest(n.ids) as doc_id, class_id, cast(copies - 1 + coalesce(links, 0) as bigint) as n_links, copies, coalesce(partners, 0) as partners
from n join c using (node) left join l using (node)
""")
def op3_bayesian_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8)
    return found.select("doc_id", "class_id", "n_links", "copies", "partners")


@query()
def op5_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.fingerprints(table(spark, sf_dir, "documents"))


@query()
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), components=16)
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


@query("""
with recursive crc as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda a, x: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i)) as t),
runs as (select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as c
  from (select coalesce(cast(doc_id as varchar), '') as doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) group by all),
bytes as (select *, hex(encode(doc_id || ':' || run)) as x from runs),
h as (select run, c, xor(4294967295, list_reduce(list_transform(range(1, length(x), 2), lambda i: cast('0x' || substr(x, i, 2) as bigint)),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1]), 4294967295)) as h from bytes, crc),
w as (select case when h % 199 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, c from h),
words as (select word, cast(sum(c) as bigint) as n from w where length(word) >= 6 group by word having sum(c) >= 5),
gaps as (select word, n, unnest(range(0, length(word))) as i from words),
shapes as (select word, n, substr(word, 1, i) || '?' || substr(word, i + 2) as shape from gaps),
cut as (select distinct word, n, substr(word, 1, i) || substr(word, i + 2) as shape from gaps),
near as (select a.word, b.word as other, b.n as m from shapes a join shapes b using (shape) where a.word <> b.word
  union select c.word, s.word, s.n from cut c join words s on s.word = c.shape union select s.word, c.word, c.n from cut c join words s on s.word = c.shape),
ranked as (select word, other, m, count(*) over (partition by word) as k from near qualify row_number() over (partition by word order by m desc, other) = 1),
known as (select word, n, coalesce(k, 0) as n_near, case when m >= 5 * n then other end as form, case when m >= 5 * n then m end as form_n from words left join ranked using (word)),
steps as (select word, word as root from known union all select s.word, k.form from steps s join known k on k.word = s.root where k.form is not null),
ends as (select s.word, s.root from steps s join known k on k.word = s.root where k.form is null)
select word, form, root, n, n_near, form_n from known join ends using (word)
""")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(spelling.count_words(table(spark, sf_dir, "documents"), least_length=6, least_count=5, one_in=199), ratio=5)


@query()
def op13_hnsw_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)
