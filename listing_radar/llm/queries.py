"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from listing_radar.llm.bpe import encode_digests
from listing_radar.llm.chat_format import canonical_turns, conversation_digests, format_turns
from listing_radar.llm.conversation_repair import repair_digests
from listing_radar.llm.embedding_dedup import embedding_dedup
from listing_radar.llm.hard_negatives import hard_negatives
from listing_radar.llm.minhash import minhash_dedup
from listing_radar.llm.packing import pack
from listing_radar.llm.quality_rules import STOP_WORDS, quality_rules
from listing_radar.llm.secret_scan import find_secrets, shown
from listing_radar.llm.suffix_dedup import repeat_digests
from listing_radar.llm.token_output import segments, token_output
from listing_radar.llm.toxicity import toxicity
from listing_radar.llm.url_filter import url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The vocabulary file of the registered queries: word_bpe_49k.json in the folder TOKENIZER_DIR, by default the box's."""
    return os.path.join(os.environ.get("TOKENIZER_DIR", "/opt/tokenizers"), "word_bpe_49k.json")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), vocabulary())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _piece_digests(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piece_digests(pack(table(spark, sf_dir, "documents"), vocabulary()))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], given.schema)
    first = F.lit(-(2**63)).cast("long")  # a turn without a number comes first
    records = given.unionByName(more).select("conv_id", F.to_json(F.struct(F.coalesce("turn", first).alias("turn"), "role", "text")).alias("record"))
    return conversation_digests(format_turns(canonical_turns(records, "conv_id", "record")), "conv_id")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(table(spark, sf_dir, "documents"), size=4)


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _piece_digests(segments(token_output(table(spark, sf_dir, "documents"), vocabulary())))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("assign", "access", "hex")
    found = find_secrets(table(spark, sf_dir, "documents"))
    kinds = F.col("spans.kind")
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in base]
    own = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select("doc_id", *counts, F.sha2(shown(own), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations damaged by a hash of their place; ``dropped`` rows stay to name their conversation. Nulls are one blank."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    case = F.crc32(F.concat_ws(":", *name)) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    text = F.when(case == 1, "").when(case == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"), text.alias("text"), (case == 0).alias("dropped"),
                                F.explode(F.when(case == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return rows.drop("copy")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_digests(damaged(table(spark, sf_dir, "conversations")), dropped=F.col("dropped"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(given.withColumn("label", label), F.col("vec_id") % 100 == 0)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_embedding_dedup, op2_bpe, op3_quality_rules, op4_packing, op5_suffix_dedup, op6_url_filter, op7_chat_format, op8_minhash, op9_token_output, op10_toxicity, op11_secret_scan, op12_conversation_repair, op13_hard_negatives)}


OP8_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end) as s from w),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from sets a join sets b on a.s = b.s and a.doc_id <> b.doc_id group by all),
links as (select x, y from common join sizes a on a.doc_id = x join sizes b on b.doc_id = y where 100 * c >= 80 * (a.n + b.n - c)),
reach as (select doc_id as node, doc_id as seen from documents union select links.y, seen from reach join links on links.x = node)
select d.doc_id, coalesce(any_value(sizes.n), 0) as n_shingles, min(seen) as component_id, min(seen) = d.doc_id as kept
from documents d join reach on node = d.doc_id left join sizes on sizes.doc_id = d.doc_id group by d.doc_id"""

OP3_SQL = r"""
with w as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from documents),
windows as (select doc_id, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 2),
named as (select doc_id, i, count(*) over (partition by doc_id, w[i], w[i + 1], w[i + 2]) as n from windows),
covered as (select doc_id, count(distinct i + k) as n from named, (select unnest([0, 1, 2]) as k) where n > 1 group by doc_id),
m as (
  select doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
    len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, len(regexp_extract_all(t, '!')) as n_exclamations,
    len(regexp_extract_all(t, '\p{Lu}')) as n_capitals, len(list_filter(w, lambda x: list_contains([STOPS], x))) as n_stop_words from w),
b as (
  select m.*, coalesce(covered.n, 0) as n_repeat_words, (n_words < 50 or 100 * coalesce(covered.n, 0) > 50 * n_words) as base_failed
  from m left join covered using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and word_chars between 2.0 * n_words and 12.0 * n_words and n_symbols <= 0.1::double * n_words
  and n_exclamations <= 0.3::double * n_words and n_capitals <= 0.3::double * word_chars and n_stop_words >= 0.02::double * n_words
  and n_dup_lines <= 0.5 * n_lines as kept
from b""".replace("STOPS", ", ".join(f"'{w}'" for word in STOP_WORDS for w in (word, word.capitalize())))


OP1_SQL = """
with recursive v as (
  select vec_id, label, embedding::double[] as e from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) as n from v),
links as (select a.vec_id as x, b.vec_id as y from u a join u b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach as (select vec_id as node, vec_id as seen from embeddings union select links.y, seen from reach join links on links.x = node),
counts as (select x, count(*) as n from links group by x)
select d.vec_id, coalesce(any_value(counts.n), 0) as n_links, min(seen) as component_id, min(seen) = d.vec_id as kept
from embeddings d join reach on node = d.vec_id left join counts on x = d.vec_id group by d.vec_id"""

OP7_SQL = r"""
with c as (
  select conv_id, coalesce(turn, -9223372036854775808) as turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(24 + length(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g')))::bigint as formatted_chars
from c group by conv_id"""


def _edit(state: str, cost: str, letter: str, line: str = "''") -> str:
    return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{letter}', t := {state}.t || {line})"


def _least(*states: str) -> str:
    return f"list_min([{', '.join(states)}])"


#: A front-to-back program over the places (start z, after s, after u, after a); no cheapest edits of a place begin another one's.
OP12_SQL = r"""
with recursive keyed as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
cased as (
  select *, xor(list_reduce([4294967295::bigint] || list_transform(string_split(k, ''), lambda c: unicode(c)::bigint),
    lambda x, c: list_reduce([xor(x, c), 1, 2, 3, 4, 5, 6, 7, 8], lambda y, i: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 20 as k20 from keyed),
damaged as (
  select conv_id, turn, case when k20 = 4 then 'user' else role end as role,
    case when k20 = 1 then '' when k20 = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when k20 = 3 then [0, 1] else [0] end) as copy
  from cased where k20 <> 0),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i from damaged),
told as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 2 when row_number() over (partition by conv_id, role, text order by i) > 1 then 3
    when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 1 else 0 end as fault, left(role, 1) as initial,
    left(role, 1) || lead(left(role, 1)) over (partition by conv_id order by i) as pair from numbered),
counts as (
  select conv_id, max(i) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 2) as blank, count(*) filter (fault = 3) as duplicate,
    count(*) filter (fault = 1) as truncated, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from told group by conv_id),
steps as (
  select distinct conv_id, 0::bigint as i, struct_pack(c := 0::bigint, a := '', t := '') as z, struct_pack(c := 1000000000::bigint, a := '', t := '') as s,
    struct_pack(c := 2::bigint, a := 'I', t := chr(10) || 'user:') as u, struct_pack(c := 4::bigint, a := 'II', t := chr(10) || 'user:' || chr(10) || 'assistant:') as a
  from told
  union all
  select conv_id, i, z, s, u1 as u, LEAST_A as a from (select conv_id, i, z, s, a0, LEAST_U as u1 from (
    select r.conv_id, r.i, DEL_Z as z, LEAST_S as s, LEAST_U0 as u0, LEAST_A0 as a0
    from steps p join (select *, case when fault < 2 then fault else 1000000000 end as f from told) r on r.conv_id is not distinct from p.conv_id and r.i = p.i + 1))),
ends as (
  select steps.conv_id, list_min([z, a]) as e from steps join counts on counts.conv_id is not distinct from steps.conv_id and counts.n = steps.i)
select d.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(e.c, 0) as cost, coalesce(e.a, '') as audit, sha256(coalesce(substr(e.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) d left join counts on counts.conv_id is not distinct from d.conv_id left join ends on ends.conv_id is not distinct from d.conv_id"""
_AS = {x: f"chr(10) || '{role}:' || r.text" for x, role in (("u", "user"), ("a", "assistant"))}


def _kept(place: str, initial: str) -> str:
    return _edit(f"p.{place}", f"case when r.initial = '{initial}' then r.f else 1000000000 end", "K", "chr(10) || r.role || ':' || r.text")


OP12_SQL = (
    OP12_SQL.replace("DEL_Z", _edit("p.z", "3", "D"))
    .replace("LEAST_S", _least(_edit("p.s", "3", "D"), _kept("z", "s")))
    .replace("LEAST_U0", _least(_edit("p.u", "3", "D"), *[x for p in "zsa" for x in (_kept(p, "u"), _edit(f"p.{p}", "2 + r.f", "R", _AS["u"]))]))
    .replace("LEAST_A0", _least(_edit("p.a", "3", "D"), _kept("u", "a"), _edit("p.u", "2 + r.f", "R", _AS["a"])))
    .replace("LEAST_U", _least("u0", *[_edit(p, "2", "I", "chr(10) || 'user:'") for p in ("z", "s", "a0")]))
    .replace("LEAST_A", _least("a0", _edit("u1", "2", "I", "chr(10) || 'assistant:'"))))


OP13_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scores as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
positives as (select * from scores where same qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select p.anchor_id, p.other_id as positive_id, row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id)::int as rank,
  n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n on n.anchor_id = p.anchor_id and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score
qualify row_number() over (partition by p.anchor_id, p.other_id order by n.score desc, n.other_id) <= 5"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_dedup": OP1_SQL, "op7_chat_format": OP7_SQL, "op3_quality_rules": OP3_SQL, "op8_minhash": OP8_SQL, "op12_conversation_repair": OP12_SQL,
            "op13_hard_negatives": OP13_SQL}
