"""Registered queries over the text tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op2_decontaminate(spark, sf_dir):
    from gridloom.llm import decontam

    found = decontam.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
    return decontam.verdict(found).select("row.doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op4_pack(spark, sf_dir):
    import public_tokenizers

    from gridloom.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_quality(spark, sf_dir):
    from gridloom.llm import quality

    return quality.judged(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op8_line_dedup(spark, sf_dir):
    from gridloom.llm import linededup

    done = linededup.dedup(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return done.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("new_text").cast("binary"), 256).alias("kept_sha256"))


@query
def op3_fixity(spark, sf_dir):
    """Audits a replica of all pages in which some records are altered and some are lost."""
    from gridloom.llm import fixity
    from gridloom.sources.workspace import stored

    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    first = stored(fixity.manifest(fixity.records(pages)), "replica")
    flipped = F.when(F.col("page_id") % 89 == 7, F.concat(F.lit("?"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html"))
    damaged = pages.where("page_id is null or page_id % 131 <> 5").withColumn("html", flipped)
    places = first.select("archive", F.col("page_id").alias("id"), "nth", "offset")
    found = fixity.records(damaged)
    same = fixity.Window.partitionBy("archive", "page_id").orderBy("digest")
    second = stored(
        found.withColumn("nth", F.row_number().over(same))
        .alias("f")
        .join(
            places.alias("p"),
            (F.col("f.archive") == F.col("p.archive")) & F.col("f.page_id").eqNullSafe(F.col("p.id")) & (F.col("f.nth") == F.col("p.nth")),
        )
        .select("f.*", "p.offset"),
        "replica",
    )
    return fixity.audit(first, second).select("archive", "page_id", "offset", "length", "kind")


SQL["op3_fixity"] = """
with r as (
  select page_id // 1000 as archive, page_id,
    octet_length(encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
      || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html'
      || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, ''))) || chr(13) || chr(10) || chr(13) || chr(10)))
      + octet_length(encode(coalesce(html, ''))) + 4 as length
  from pages),
m as (
  select *, coalesce(sum(length) over (partition by archive order by page_id rows between unbounded preceding and 1 preceding), 0)
    as "offset" from r)
select archive, page_id, cast("offset" as bigint) as "offset", length, case when page_id % 131 = 5 then 'missing' else 'altered' end as kind
from m where page_id % 131 = 5 or page_id % 89 = 7"""


@query
def op5_chat(spark, sf_dir):
    from gridloom.llm import chat

    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.formatted(turns))


_ESCAPED = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(coalesce({0}, ''), '␛', '␛e'),
  '<(\|)', '<␛c\1', 'g'), '<(/?s>)', '<␛c\1', 'g'), '\[(/?INST\])', '[␛c\1', 'g'), '\|(>)', '|␛c\1', 'g')"""
SQL["op5_chat"] = f"""
with t as (
  select conv_id, turn, role, text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, {_ESCAPED.format('role')} as er, {_ESCAPED.format('text')} as et
  from t),
s as (
  select *, coalesce(lag(role) over (partition by conv_id order by turn nulls first, er, et) = role, false) as same from e)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, er, et)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, er, et) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(et) + case when same then 8 else length(er) + 10 + 7 end) as bigint) as formatted_chars
from s group by conv_id"""


@query
def op6_near_duplicates(spark, sf_dir):
    from gridloom.llm import neardup

    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


@query
def op1_extract_html(spark, sf_dir):
    from gridloom.llm import html

    return html.extract(table(spark, sf_dir, "pages"), ["page_id", "url"]).select("row.page_id", "row.url", "text", "n_chars")


@query
def op9_language(spark, sf_dir):
    from gridloom.llm import langid

    found = langid.identify(table(spark, sf_dir, "documents"), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("row.doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op10_substring_dedup(spark, sf_dir):
    from gridloom.llm import suffixdedup

    done = suffixdedup.dedup(table(spark, sf_dir, "documents"), ["doc_id"])
    return done.select(
        "row.doc_id",
        "n_bytes",
        F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0]).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.octet_length("kept").cast("long").alias("n_kept"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text"),  # a cut may divide a character
    )


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"""regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

SQL["op2_decontaminate"] = f"""
with w as (select doc_id, {_WORDS} as ws from documents),
b as (select item_id, {_WORDS} as ws from benchmark),
p as (
  select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as g
  from (select item_id, ws, least(13, len(ws)) as n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) as i from b where len(ws) > 0)),
d as (
  select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as g
  from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w, (select distinct n from p) where len(ws) >= n)),
hits as (select distinct doc_id, i, n, item_id from d join p using (n, g)),
h as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) group by 1),
m as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
  from (select distinct doc_id, cast(item_id as varchar) as item from hits) group by 1)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join h using (doc_id) left join m using (doc_id)"""

SQL["op8_line_dedup"] = f"""
with t as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from t),
k as (select *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} as key from l),
f as (select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10)
select doc_id, count(*) as n_lines, count(*) filter (key in (select key from f)) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (key not in (select key from f)), '')) as kept_sha256
from k group by doc_id"""


@query
def op11_prefix_trie(spark, sf_dir):
    from gridloom.llm import trie

    found = trie.prefix_trie(table(spark, sf_dir, "conversations"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split({0}, ''), lambda s: ascii(s)::bigint)),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 1, 2, 3, 4, 5, 6, 7]::bigint[]), lambda p, q: xor(p >> 1, (p & 1) * 3988292384))))"""

SQL["op11_prefix_trie"] = f"""
with t as (
  select conv_id, turn, struct_pack(role := coalesce(role, ''), said := coalesce(text, '')) as x from conversations where conv_id is not null),
c as (select conv_id, list(x order by turn nulls first, x) as xs, {_CRC.format("any_value(conv_id)::varchar")} % 9 as h from t group by conv_id),
r as (
  select c.conv_id, list_concat(coalesce(b.xs[1:c.h], []), c.xs[c.h + 1:]) as xs
  from c left join c b on b.conv_id = c.conv_id - c.conv_id % 5),
m as (select conv_id, len(xs) as n, d, xs[1:d] as p from (select *, unnest(range(len(xs) + 1)) as d from r)),
u as (
  select p, d as depth, min(conv_id) as conv_id, count(*) as n_convs,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends_sha256
  from m group by p, d),
k as (select p[1:depth - 1] as p, depth - 1 as depth, count(*) as n_children from u where depth > 0 group by all),
w as (
  select u.*, coalesce(n_children, 0) as n_children,
    case when u.depth = 0 then 0 else (n_convs - 1) * octet_length(encode(u.p[u.depth].said)) end as saving
  from u left join k on k.depth = u.depth and k.p = u.p),
s as (
  select a.p, a.depth, count(*) filter (v.n_children = 0) as n_leaves, cast(sum(v.saving) as bigint) as saved_tokens
  from w a join w v on v.depth >= a.depth and v.p[1:a.depth] = a.p group by all)
select w.conv_id, w.depth, above.conv_id as parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
from w join s on s.depth = w.depth and s.p = w.p left join u above on above.depth = w.depth - 1 and above.p = w.p[1:w.depth - 1]"""


@query
def op13_vector_codes(spark, sf_dir):
    from gridloom.llm import vectorcodes

    found = vectorcodes.compressed(table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


_NEAREST = """select n, g, arg_min(e, (dist, e)) as e, min(dist) as dist from (
    select v.n, v.g, b.e, sum((v.x - b.x) * (v.x - b.x)) as dist from v join {0} b using (g, i) group by v.n, v.g, b.e) group by n, g"""
_MOVED = """select b.g, b.e, b.i, coalesce(cast(floor(m.x) as bigint), b.x) as x from {0} b left join (
    select v.g, a.e, v.i, floor(sum(v.x)::hugeint * 1.0 / count(*)) as x from v join {1} a using (n, g) group by v.g, a.e, v.i) m using (g, e, i)"""

SQL["op13_vector_codes"] = f"""
with k as (
  select row_number() over (order by vec_id) - 1 as n, vec_id, label, embedding from embeddings
  where embedding is not null and coalesce(list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x))), true)),
u as (select n, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i, len(embedding) // 16 as w from k),
v as (select n, i // w as g, i, cast(floor(256 * x::double) as bigint) as x from u),
b0 as (select g, n as e, i, x from v where n < 64),
a0 as ({_NEAREST.format("b0")}), b1 as ({_MOVED.format("b0", "a0")}),
a1 as ({_NEAREST.format("b1")}), b2 as ({_MOVED.format("b1", "a1")}),
a2 as ({_NEAREST.format("b2")}),
c as (select n, string_agg(lpad(lower(to_hex(e)), 2, '0'), '' order by g) as code, cast(sum(dist) as bigint) as error from a2 group by n),
s as (select label, cast(sum(error) as bigint) as label_error from c join k using (n) group by label)
select vec_id, code, error, label_error, (select sha256(string_agg(x::varchar, ',' order by g, e, i)) from b2) as codebooks_sha256
from c join k using (n) join s on s.label is not distinct from k.label"""


@query
def op12_toxicity(spark, sf_dir):
    from gridloom.llm import toxicity

    found = toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    held = F.coalesce(F.crc32(F.col("row.doc_id").cast("string")) % 4 == 2, F.lit(False))
    return found.select("row.doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
