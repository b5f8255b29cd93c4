"""Text keys: normalisation, classifier, standardisation, fingerprints and profiles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from propspark.catalog.base import r6, table
from propspark.functions.text import EXPECTED_BUCKETS, Category, classify, normalize_text
from propspark.operators import fingerprints as P
from propspark.operators.selectors import BitFrequencySelector
from propspark.operators.standardize import standardize_key, standardize_with, strip_fragments
from propspark.operators.summaries import counts_by_reason, counts_with_zeros
from propspark.session import cut_lineage
from propspark.sources.tables import spread_scan


def documents(spark, root):
    return spread_scan(table(spark, root, "documents"), "doc_id")


def text_normalize(spark, root):
    d = documents(spark, root)
    missing = F.when(F.col("lang") != "de", F.col("source"))
    return d.select("doc_id", normalize_text(F.col("text"), F.col("lang"), missing, fixes=(("onthe", "on the"),)).alias("text"))


WORD_CLASSES = (
    Category("german", (r"\bund\b", r"\bder\b")),
    Category("english", (r"\bthe\b", r"\bof\s+and\b"), (r"\blicen[cs]e\b", r"[0-9]{4}")),
    Category("numeric", (r"[0-9]{2,}", r"@\w+")),
)


def pattern_classifier(spark, root):
    """Ordered classes with vetoes: a vetoed text tries the next class."""
    text = normalize_text(F.col("text"), F.col("source"))
    return documents(spark, root).select("doc_id", classify(text, WORD_CLASSES).alias("bucket"))


def classifier_counts(spark, root):
    """Clearance classes of assay descriptions made from order and document fields, zero classes listed."""
    o = table(spark, root, "orders")
    phrase = F.when(F.col("o_orderstatus") == "F", F.lit("intrinsic  clearance in")).when(F.col("o_orderstatus") == "O", F.lit("Unbound\tintrinsic")).otherwise(F.lit("apparent"))
    unit = F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("mL/min/kg")).when(F.col("o_orderpriority") == "5-LOW", F.lit("uL/min"))
    text = normalize_text(phrase, F.col("o_orderpriority"), unit)
    return counts_with_zeros(o.select(classify(text).alias("classification_bucket")), "classification_bucket", EXPECTED_BUCKETS)


def _keys(spark, root):
    """Document texts with blank and missing ones among them."""
    d = documents(spark, root)
    return d.select("doc_id", F.when(F.col("source") == "src3", F.lit("  \n ")).when(F.col("source") != "src4", F.col("text")).alias("key"))


KEYS = """(select doc_id, case when source = 'src3' then e'  \\n ' when source <> 'src4' then text end as key from documents)"""
VALID = r"^[A-Za-z]"


def standardized_keys(spark, root):
    out = standardize_key(_keys(spark, root), "key", valid_regex=VALID, separator=".", strip=["The", " the"], lower=True, collapse=True)
    return out.select("doc_id", "key_standardized", "preprocess_reason")


def reason_counts(spark, root):
    return counts_by_reason(standardize_key(_keys(spark, root), "key", valid_regex=VALID))


def stripped_fragments(spark, root):
    return table(spark, root, "part").select("p_partkey", strip_fragments(F.col("p_name"), " ", ["small", "ring", "red"]).alias("core"))


def standardize_hook(spark, root):
    """A user's own function per key, with its exceptions as reason codes."""

    def fn(text):
        if "@" in text:
            raise ValueError(text)
        return text.upper().strip(), None

    return standardize_with(_keys(spark, root), "key", fn).groupBy("preprocess_reason").agg(
        F.count(F.lit(1)).alias("n"), F.count("key_standardized").alias("n_keys"))


def neighbourhood_bits(spark, root):
    d = documents(spark, root)
    return d.select("doc_id", F.array_join(P.neighbourhood_bits(F.col("text"), P.NeighbourhoodConfig(2, 1024)), ",").alias("bits"))


def path_bits(spark, root):
    return table(spark, root, "benchmark").select("item_id", F.array_join(P.path_bits(F.col("text"), P.PathConfig(1, 5, 2048)), ",").alias("bits"))


def path_bits_documents(spark, root):
    d = documents(spark, root).select("doc_id", P.path_bits(F.col("text"), P.PathConfig(2, 4, 4096)).alias("b"))
    return d.select("doc_id", F.size("b").cast("bigint").alias("n_on"), F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bit_sum"))


def substructure_bits(spark, root):
    d = documents(spark, root).select("doc_id", P.substructure_bits(F.col("text"), P.SubstructureConfig(3, 1024)).alias("b"))
    return d.select("doc_id", F.size("b").cast("bigint").alias("n_on"), F.aggregate("b", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("bit_sum"))


def text_profile(spark, root):
    d = P.text_profile(documents(spark, root).select("doc_id", "text"), "text")
    return d.select("doc_id", *[r6(c) for c in P.PROFILE_COLUMNS])


def bit_selector(spark, root):
    d = documents(spark, root).select("doc_id", P.substructure_bits(F.col("text")).alias("bits"))
    sel = BitFrequencySelector(0.02, 0.6).fit(d, "bits", 1024)
    return sel.support().select(F.col("bit").cast("bigint").alias("bit"), r6("frequency"))


def selected_bits(spark, root):
    d = cut_lineage(documents(spark, root).select("doc_id", P.substructure_bits(F.col("text")).alias("bits")))
    out = BitFrequencySelector(0.02, 0.6).fit(d, "bits", 1024).transform(d, "bits")
    return out.select("doc_id", F.size("bits").cast("bigint").alias("n_on"))


def projection(spark, root):
    """Coordinates to three decimals, as the matrix product sums floats in an order of its own."""
    at = F.transform(P.project("embedding", 64, 16), lambda x: F.round(x.cast("double"), 3) + F.lit(0.0))
    return table(spark, root, "embeddings").select("vec_id", F.posexplode(at).alias("axis", "projected"))


def vector_norms(spark, root):
    dot = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return table(spark, root, "embeddings").select("vec_id", r6(F.sqrt(dot), "norm"))


def embed_hook(spark, root):
    def encode(texts):
        return np.array([[len(t), t.count(" "), sum(c.isdigit() for c in t)] for t in texts], dtype=np.float32)

    out = P.embed(documents(spark, root).select("doc_id", "text"), encode, "text", 3)
    return out.select("doc_id", *[F.col("embedding")[i].cast("bigint").alias(n) for i, n in enumerate(("chars", "blanks", "digits"))])


QUERIES = {f.__name__: f for f in (
    text_normalize, pattern_classifier, classifier_counts, standardized_keys, reason_counts, stripped_fragments, standardize_hook,
    neighbourhood_bits, path_bits, path_bits_documents, substructure_bits, text_profile, bit_selector, selected_bits, projection,
    vector_norms, embed_hook,
)}

BLANKS = r"[\t\n\x0B\f\r ]+"


def norm_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{BLANKS}', ' ', 'g'))"


def words_sql(text: str) -> str:
    return f"list_filter(string_split({norm_sql(text)}, ' '), lambda w: w <> '')"


def words_table(source: str, key: str) -> str:
    """One row per word with its position."""
    return f"(select {key}, unnest(w) as w, generate_subscripts(w, 1) as i from (select {key}, {words_sql('text')} as w from {source}))"


def chars_table(source: str, key: str) -> str:
    return f"""(select {key}, unnest(c) as w, generate_subscripts(c, 1) as i from
        (select {key}, string_split(array_to_string({words_sql('text')}, ' '), '') as c from {source}))"""


def bits_sql(key: str, pieces: str, n: int) -> str:
    """Distinct (key, bit) of a table of text pieces."""
    return f"(select distinct {key}, ('0x' || substr(md5(s), 1, 8))::bigint % {n} as b from ({pieces}) where s is not null)"


def runs_sql(items: str, key: str, lo: int, hi: int, glue: str) -> str:
    win = f"over (partition by {key} order by i)"
    return " union all ".join(
        f"select {key}, w" + "".join(f" || '{glue}' || lead(w, {j}) {win}" for j in range(1, k)) + f" as s from {items}" for k in range(lo, hi + 1))


def path_sql(source: str, key: str, lo: int, hi: int, n: int) -> str:
    return bits_sql(key, runs_sql(words_table(source, key), key, lo, hi, " "), n)


def chars_sql(source: str, key: str, n: int, size: int = 3) -> str:
    return bits_sql(key, runs_sql(chars_table(source, key), key, size, size, ""), n)


def around_sql(source: str, key: str, radius: int, n: int) -> str:
    pieces = " union all ".join(
        f"""select {key}, '{r}:' || string_agg(w, ' ') over (partition by {key} order by i rows between {r} preceding and {r} following) as s
            from {words_table(source, key)}""" for r in range(radius + 1))
    return bits_sql(key, pieces, n)


def listed_sql(source: str, key: str, bits: str) -> str:
    return f"select t.{key}, coalesce(string_agg(b, ',' order by b), '') as bits from {source} t left join {bits} x on x.{key} = t.{key} group by 1"


def counted_sql(source: str, key: str, bits: str) -> str:
    return f"select t.{key}, count(b) as n_on, coalesce(sum(b), 0)::bigint as bit_sum from {source} t left join {bits} x on x.{key} = t.{key} group by 1"


def classify_sql(text: str, classes) -> str:
    def hit(pats):
        return "(" + " or ".join(f"regexp_matches({text}, '{p}', 'i')" for p in pats) + ")"

    whens = "".join(f" when {hit(c.patterns)}" + (f" and not {hit(c.vetoes)}" if c.vetoes else "") + f" then '{c.name}'" for c in classes)
    return f"case{whens} else 'unknown' end"


_STD = f"""select doc_id, trim(regexp_replace(key, '^{BLANKS}|{BLANKS}$', '', 'g')) as raw from {KEYS}"""
_CHAR_BITS = chars_sql("documents", "doc_id", 1024)
_SUPPORT = f"""(select b as bit, count(*) / (select count(*) from documents) as frequency
 from {_CHAR_BITS} group by 1 having count(*) / (select count(*) from documents) between 0.02 and 0.6)"""

_MATRIX = ", ".join("[" + ", ".join(f"{float(x)!r}::double" for x in col) + "]" for col in P.projection_matrix(64, 16, 0).T)
ORACLES = {
    "projection": f"select vec_id, (axis - 1)::integer as axis, round(list_dot_product(embedding::double[], m[axis]), 3) + 0.0 as projected from embeddings, (select [{_MATRIX}] m), range(1, 17) r(axis)",

    "text_normalize": f"""select doc_id, trim(regexp_replace(replace(lower(text || ' | ' || lang || ' | ' || case when lang <> 'de' then source else '' end),
        'onthe', 'on the'), '{BLANKS}', ' ', 'g')) as text from documents""",
    "pattern_classifier": f"""select doc_id, {classify_sql('t', WORD_CLASSES)} as bucket
        from (select doc_id, {norm_sql("text || ' | ' || source")} as t from documents)""",
    "classifier_counts": """with o as (select case when o_orderstatus = 'O' then 'unbound' when o_orderstatus = 'F' and o_orderpriority <> '1-URGENT' then 'intrinsic'
        when o_orderpriority = '1-URGENT' then 'hepatic' else 'unknown' end as b from orders)
        select v.b as classification_bucket, count(o.b) as n from (values ('intrinsic'), ('unbound'), ('hepatic'), ('unknown')) v(b) left join o on o.b = v.b group by 1""",
    "standardized_keys": f"""with s as ({_STD}), p as (select doc_id, raw, string_split(raw, '.') as f from s),
        k as (select doc_id, raw, list_filter(f, lambda x: x not in ('The', ' the')) as kept, f from p),
        n as (select doc_id, raw, trim(regexp_replace(lower(array_to_string(case when len(kept) > 0 then kept else f end, '.')), '{BLANKS}', ' ', 'g')) as key from k),
        r as (select *, case when coalesce(raw, '') = '' then 'empty_smiles' when not regexp_matches(raw, '{VALID}') then 'invalid_smiles'
            when key = '' then 'empty_after_desalt' end as reason from n)
        select doc_id, case when reason is null then key end as key_standardized, reason as preprocess_reason from r""",
    "reason_counts": f"""select case when coalesce(raw, '') = '' then 'empty_smiles' when not regexp_matches(raw, '{VALID}') then 'invalid_smiles' end as preprocess_reason,
        count(*) as n from ({_STD}) group by 1""",
    "stripped_fragments": """select p_partkey, array_to_string(case when len(k) > 0 then k else f end, ' ') as core from (select p_partkey, string_split(p_name, ' ') as f,
        list_filter(string_split(p_name, ' '), lambda x: x not in ('small', 'ring', 'red')) as k from part)""",
    "standardize_hook": f"""select case when coalesce(raw, '') = '' then 'empty_smiles' when contains(raw, '@') then 'standardize_error:ValueError' end as preprocess_reason,
        count(*) as n, count(*) filter (where coalesce(raw, '') <> '' and not contains(raw, '@')) as n_keys from ({_STD}) group by 1""",
    "neighbourhood_bits": listed_sql("documents", "doc_id", around_sql("documents", "doc_id", 2, 1024)),
    "path_bits": listed_sql("benchmark", "item_id", path_sql("benchmark", "item_id", 1, 5, 2048)),
    "path_bits_documents": counted_sql("documents", "doc_id", path_sql("documents", "doc_id", 2, 4, 4096)),
    "substructure_bits": counted_sql("documents", "doc_id", _CHAR_BITS),
    "text_profile": f"""with a as (select doc_id, text, length(text) as n, {words_sql('text')} as w, string_split(text, e'\\n') as l from documents)
        select doc_id, n::double as n_chars, len(w)::double as n_words, round(len(list_distinct(w)) / nullif(len(w), 0), 6) as distinct_word_ratio,
        round(length(array_to_string(w, '')) / nullif(len(w), 0), 6) as mean_word_len,
        round((n - length(regexp_replace(text, '[0-9]', '', 'g'))) / nullif(n, 0), 6) as digit_share,
        round((n - length(regexp_replace(text, '[.,;:!?]', '', 'g'))) / nullif(n, 0), 6) as punct_share,
        round((n - length(regexp_replace(text, '[A-Z]', '', 'g'))) / nullif(n, 0), 6) as upper_share,
        len(l)::double as n_lines, round(1 - len(list_distinct(l)) / len(l), 6) as repeated_line_ratio from a""",
    "bit_selector": f"select bit, round(frequency, 6) as frequency from {_SUPPORT}",
    "selected_bits": f"""with x as {_CHAR_BITS}, s as {_SUPPORT.replace(_CHAR_BITS, 'x')}
        select t.doc_id, count(s.bit) as n_on from documents t left join x on x.doc_id = t.doc_id left join s on s.bit = x.b group by 1""",
    "vector_norms": "select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as norm from embeddings",
    "embed_hook": """select doc_id, length(text) as chars, length(text) - length(replace(text, ' ', '')) as blanks,
        length(text) - length(regexp_replace(text, '[0-9]', '', 'g')) as digits from documents""",
}
