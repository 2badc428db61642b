"""The registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlake.llm.tables import table


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlake.llm import media

    return media.read_media(media.store(media.with_media(table(spark, sf_dir, "documents"))))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlake.llm import ngram_join

    return ngram_join.link_components(table(spark, sf_dir, "documents"), k=4, share=85)


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlake.llm import secrets

    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlake.llm import chat

    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = F.inline(F.array(*(F.struct(F.lit(-7).cast("long"), F.lit(i).cast("long"), F.lit(role), F.lit(said)) for i, role in enumerate(("user", "assistant")))))
    more = spark.range(1).select(extra.alias("conv_id", "turn", "role", "text"))
    return chat.digests(chat.render(chat.fold(chat.as_streamed_events(rows.union(more)))))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlake.llm import fingerprints

    return fingerprints.with_next(table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlake.llm import substrings

    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=20).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from emberlake.llm import packing

    pieces = packing.pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True)
    return packing.digests(packing.pack(pieces))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlake.llm import warc

    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return warc.history(table(spark, sf_dir, "pages"), least_bytes=0).select(columns)


def op8_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlake.llm import mixing

    rows = mixing.in_training_order(mixing.laps(table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from emberlake.llm import quality

    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_secret_scans": op2_secret_scans,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_document_fingerprints": op4_document_fingerprints,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_warc": op7_warc,
    "op8_mixing_sources": op8_mixing_sources,
    "op9_media_columns": op9_media_columns,
    "op10_quality_classifier": op10_quality_classifier,
}

WORD = r"[^\x20\x09-\x0D]+"

_CHAT_SQL = r"""
with said as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
escaped as (select *, length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '#', '\h')) as body, length(replace(replace(replace(replace(role, '\', '\b'), '<', '\l'), '#', '\h'), ':', '\c')) as head from said)
select conv_id, count(*) as n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + head + 2 + body + 8) as bigint) as formatted_chars
from escaped group by conv_id"""

_REPEATS_SQL = rf"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as w from documents),
lists as (select doc_id, list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i+19], ' ')) as g from d where len(w) >= 20),
wins as (select doc_id, unnest(g) as g, unnest(range(1, len(g) + 1)) as s from lists),
marked as (select doc_id, s, row_number() over (partition by g order by doc_id, s) as nth from wins),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as p from marked where nth > 1),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from words anti join gone using (doc_id, p) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # fixed value of base32
_BASE32 = " || ".join(f"substr('{_ALPHABET}', cast((('0x' || substr(h, {5 * i + 1}, 5))::bigint >> {shift}) & 31 as integer) + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))

_WARC_SQL = f"""
with p as (select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages), f as (select *, min(page_id) over (partition by html) as first from p)
select page_id, cast(strlen(html) as bigint) as payload_bytes, {_BASE32} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to from f"""

_MIX_SQL = rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size, md5(coalesce(cast(doc_id as varchar), concat('null', coalesce(text, '')))) as key from documents),
per as (select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source nulls last) - 1 as n from d group by source),
w as (select *, [3, 1, 2][cast(n % 3 as integer) + 1] as weight, 2 * source_size as cap from per),
r as (select *, cast(cap as double) / weight as ratio from w),
lv as (select *, (cast(1.5 as double) * cast(sum(source_size) over () as bigint) - cast(coalesce(sum(cap) over (order by ratio, n rows between unbounded preceding and 1 preceding), 0) as bigint))
  / cast(sum(weight) over (order by ratio, n rows between current row and unbounded following) as bigint) as level from r),
goal as (select source, source_size, coalesce(least(cast(cap as double), (select arg_min(level, (ratio, n)) from lv where level * weight <= cap) * weight), cast(cap as double)) as target from lv),
o as (select d.*, g.source_size, g.target, coalesce(sum(size) over (partition by d.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from d join goal g on d.source is not distinct from g.source)
select doc_id, size, source_size, target, cast(case when source_size = 0 then 0 else floor(floor(target) / source_size) * size + greatest(0, least(size, floor(target) - floor(floor(target) / source_size) * source_size - before)) end as bigint) as taken from o"""

_JOIN_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as (select doc_id, case when len(w) >= 4 then list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as g from d),
flat as (select doc_id, len(g) as n, unnest(g) as g from s),
links as (select a.doc_id as x, b.doc_id as y from flat a join flat b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2 having 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
sym as (select x, y from links union all select y, x from links),
reach as (select doc_id, doc_id as root from s union select sym.y, reach.root from reach join sym on sym.x = reach.doc_id)
select s.doc_id, cast(len(g) as bigint) as n_shingles, min(root) as component_id from s join reach using (doc_id) group by all"""

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": _JOIN_SQL,
    "op3_chat_formatting": _CHAT_SQL,
    "op5_substring_dedup": _REPEATS_SQL,
    "op7_warc": _WARC_SQL,
    "op8_mixing_sources": _MIX_SQL,
}
