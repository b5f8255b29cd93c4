"""The registered queries of the corpus operators, one for each, over the whole of its table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from propspark.llm.audit import audited
from propspark.llm.audit import sql as audit_sql
from propspark.llm.common import read, text_of, words_of
from propspark.llm.grades import fitted, graded
from propspark.llm.lexical import search
from propspark.llm.lexical import sql as lexical_sql
from propspark.llm.licenses import scanned
from propspark.llm.licenses import sql as license_sql
from propspark.llm.mixing import mixed
from propspark.llm.neighbours import nearest
from propspark.llm.packing import packed
from propspark.llm.quality import checked
from propspark.llm.quality import sql as quality_sql
from propspark.llm.recipes import exact_duplicates
from propspark.llm.recipes import sql as recipe_sql
from propspark.llm.sharding import sharded
from propspark.llm.simhash import near_duplicates
from propspark.llm.toolcalls import linked
from propspark.llm.urls import judged_urls, labelled_urls


def op1_packing(spark: SparkSession, root: str) -> DataFrame:
    return packed(read(spark, root, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op2_licenses(spark: SparkSession, root: str) -> DataFrame:
    return scanned(read(spark, root, "documents")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", F.round("score", 6).alias("score"))


def op3_sharding(spark: SparkSession, root: str) -> DataFrame:
    return sharded(read(spark, root, "documents"), 16).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Every user turn asks: the first of a conversation freely, a later one about the call two turns before.
TOOLS = {
    "ask": {"text": {"type": "string", "required": True, "min": 1, "max": 200}, "turn": {"type": "integer", "required": True, "min": 0}},
    "follow_up": {"text": {"type": "string", "required": True, "min": 1, "max": 150}, "turn": {"type": "integer", "required": True, "min": 1},
                  "after": {"type": "call", "required": True}},
}


def op4_tool_calls(spark: SparkSession, root: str) -> DataFrame:
    turns = read(spark, root, "conversations")
    call = lambda back: F.format_string("call-%d-%d", F.col("conv_id"), F.col("turn") - back)
    after = F.when(F.col("turn") >= 2, call(2))
    calls = turns.filter("role = 'user'").select(
        "conv_id", call(0).alias("call_id"), "turn", F.when(after.isNull(), "ask").otherwise("follow_up").alias("name"),
        F.to_json(F.struct("turn", F.col("text").alias("text"), after.alias("after"))).alias("arguments"))
    results = turns.filter("role = 'assistant'").select("conv_id", call(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return linked(calls, results, TOOLS)


OP4_SQL = """
with recursive u as (select conv_id, turn, text, printf('call-%d-%d', conv_id, turn) call_id, turn >= 2 as later from conversations where role = 'user'),
a as (select conv_id, turn, text, printf('call-%d-%d', conv_id, turn - 1) call_id from conversations where role = 'assistant'),
lv as (select u.call_id, 0 as level from u left join u p on p.conv_id = u.conv_id and p.turn = u.turn - 2 where not u.later or p.turn is null
  union all select u.call_id, lv.level + 1 from u join lv on lv.call_id = printf('call-%d-%d', u.conv_id, u.turn - 2)),
r as (select call_id, count(*) n, min(turn) t, arg_min(text, (turn, text)) content from a group by call_id),
e as (select u.*, concat_ws('; ',
    case when later and length(text) > 150 then 'text: above 150' when not later and length(text) > 200 then 'text: above 200' when length(text) < 1 then 'text: below 1' when text is null then 'text: missing' end,
    case when later and not exists (select 1 from u p where p.conv_id = u.conv_id and p.turn = u.turn - 2) then 'needs a call that is not there' end) errs from u)
select e.conv_id, e.call_id, e.turn, case when later then 'follow_up' else 'ask' end as name, case when r.n > 0 then 'linked' else 'unanswered' end status,
  lv.level, coalesce(r.n, 0) n_results, errs = '' as valid, errs as errors,
  '{"arguments":{' || case when later then '"after":' || to_json(printf('call-%d-%d', e.conv_id, e.turn - 2)) || ',' else '' end
    || case when text is null then '' else '"text":' || to_json(text) || ',' end || '"turn":' || turn || '},"call_id":' || to_json(e.call_id)
    || case when content is null then '' else ',"content":' || to_json(content) end || ',"name":"' || case when later then 'follow_up' else 'ask' end || '"}' as json
from e join lv on lv.call_id = e.call_id left join r on r.call_id = e.call_id
union all
select conv_id, call_id, turn, null, 'orphan', null, 1, false, '', '{"call_id":' || to_json(call_id) || case when text is null then '' else ',"content":' || to_json(text) end || '}'
from a where call_id not in (select call_id from u)"""


def op5_quality(spark: SparkSession, root: str) -> DataFrame:
    return checked(read(spark, root, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_neighbours(spark: SparkSession, root: str) -> DataFrame:
    return nearest(read(spark, root, "embeddings"), lambda i: i % 20 == 0, 20)


#: Toxic texts are the lowest grade, poor ones the middle, all others the best.
GRADE = "case when toxic = 1 then 0 when quality = 0 then 1 when toxic is not null and quality is not null then 2 end"


def op7_grades(spark: SparkSession, root: str) -> DataFrame:
    docs = read(spark, root, "documents")
    out = graded(docs, fitted(docs, read(spark, root, "labels"), F.expr(GRADE)), F.col("doc_id"))
    tail = lambda k: F.get("tails", F.lit(k - 1))
    return out.select("doc_id", "expected_grade", tail(1).alias("p_grade_1"), tail(2).alias("p_grade_2"), (tail(2) >= 0.4).alias("kept"))


def op8_mixing(spark: SparkSession, root: str) -> DataFrame:
    size = F.size(words_of(text_of()))
    return mixed(read(spark, root, "documents"), size).select("doc_id", "size", "source_size", "target", "taken")


def op9_urls(spark: SparkSession, root: str) -> DataFrame:
    return judged_urls(read(spark, root, "pages"), labelled_urls(spark)).select("page_id", "host", "path", "rule", "verdict")


def op10_simhash(spark: SparkSession, root: str) -> DataFrame:
    return near_duplicates(read(spark, root, "documents"), radius=2, shingle=3)


def op11_recipes(spark: SparkSession, root: str) -> DataFrame:
    return exact_duplicates(read(spark, root, "documents"))


def op12_audit(spark: SparkSession, root: str) -> DataFrame:
    return audited(read(spark, root, "documents"), read(spark, root, "labels"))


def op13_lexical(spark: SparkSession, root: str) -> DataFrame:
    return search(read(spark, root, "documents"), read(spark, root, "benchmark"), 10)


QUERIES = {f.__name__: f for f in (op1_packing, op2_licenses, op3_sharding, op4_tool_calls, op5_quality, op6_neighbours, op7_grades, op8_mixing, op9_urls, op10_simhash, op11_recipes, op12_audit, op13_lexical)}
ORACLES: dict[str, str] = {"op2_licenses": license_sql(), "op4_tool_calls": OP4_SQL, "op5_quality": quality_sql(), "op11_recipes": recipe_sql(), "op12_audit": audit_sql(), "op13_lexical": lexical_sql()}
