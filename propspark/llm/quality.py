"""Quality rules: how far a document's characters and common words lie from its language, in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import Stored, group_key, text_of, words_of

#: Function words that make up a large part of running text in each language, as many for each.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los"),
}
#: Counted classes; spaces, symbols and all others make up the rest.
CHAR_CLASSES = {"upper": "\\p{Lu}", "digits": "[0-9]", "marks": "[!\"'()+,./:;=?@\\[\\\\\\]^_`{}~-]"}
SYMBOLS = "[#*$%&|<>]"
CHARS = ("n_spaces", "n_symbols", "n_upper", "n_digits", "n_marks", "n_others")
WORDS = tuple(f"n_common{k}" for k in range(8)) + ("n_rare",)
#: A word's position shares 64 bits with a hash; longer texts compare the windows themselves.
POSITION_BITS = 24


def repeat_words(n: str, words: str, position_bits: int = POSITION_BITS) -> tuple[str, str, str]:
    """Three expressions, each over the column that the one before makes.

    ``windows``: the 3-word windows as sorted numbers, upper hash bits above the position. ``pairs``: the
    places in it where two neighbours share the hash bits. The last: words in windows that occur twice or
    more. Neighbours are compared word by word; where equal bits hide other words, or the position does
    not fit, the windows themselves are sorted.
    """
    low = (1 << position_bits) - 1
    fits = f"({n} <= {low})"
    at = lambda i: f"cast(windows[{i}] & {low}L as int)"
    windows = f"""case when {n} < 4 or not {fits} then cast(array() as array<bigint>) else sort_array(transform(sequence(0, {n} - 3),
        i -> (xxhash64({words}[i], {words}[i + 1], {words}[i + 2]) & {~low}L) | cast(i as bigint))) end"""
    pairs = f"""case when size(windows) < 2 then cast(array() as array<int>) else filter(sequence(1, size(windows) - 1),
        i -> shiftright(windows[i], {position_bits}) = shiftright(windows[i - 1], {position_bits})) end"""
    same = " and ".join(f"{words}[{at('i')} + {k}] = {words}[{at('i - 1')} + {k}]" for k in range(3))
    # Sorted starts of repeated windows; each covers three words, less what the next one covers.
    covered = lambda starts: f"""aggregate({starts}, named_struct('n', 0L, 'end', 0),
        (acc, x) -> named_struct('n', acc.n + 3 - greatest(0, acc.end - x), 'end', x + 3), acc -> acc.n)"""  # noqa: E731
    fast = covered(f"sort_array(array_union(transform(pairs, i -> {at('i')}), transform(pairs, i -> {at('i - 1')})))")
    whole = f"""sort_array(transform(sequence(0, {n} - 3), i -> named_struct('a', {words}[i], 'b', {words}[i + 1], 'c', {words}[i + 2], 'i', i)))"""
    slow = f"""transform(array({whole}), s -> {covered('''sort_array(array_distinct(flatten(transform(filter(sequence(1, size(s) - 1),
        i -> s[i].a = s[i - 1].a and s[i].b = s[i - 1].b and s[i].c = s[i - 1].c), i -> array(s[i].i, s[i - 1].i)))))''')})[0]"""
    words_in = f"""case when {n} < 4 then 0L when {fits} and size(pairs) = 0 then 0L
        when {fits} and forall(pairs, i -> {same}) then {fast} else {slow} end"""
    return windows, pairs, words_in


def measured(docs: DataFrame, *carry: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row the columns of ``carry``, ``doc_id``, ``lang_key``, the base counts, and both histograms.

    A null text counts as empty. The whole text is read, once; nothing is shuffled.
    """
    text = text_of(text_col)
    ids = [*carry, F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang")]
    rows = docs.select(*ids, text.alias("text"), words_of(text).alias("words"))
    rows = rows.withColumn("n", F.size("words"))
    windows, pairs, words_in = repeat_words("n", "words")
    rows = rows.withColumn("windows", F.expr(windows)).withColumn("pairs", F.expr(pairs))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    count = lambda pattern: (F.length("text") - F.length(F.regexp_replace("text", pattern, ""))).cast("long")
    common = F.lit(None).cast("array<string>")
    for lang, known in COMMON_WORDS.items():
        common = F.when(F.col("lang") == lang, F.array(*[F.lit(w) for w in known])).otherwise(common)
    rows = rows.withColumn("common", common).withColumn("lines", lines)
    names = [c for c in rows.columns if c not in ("text", "words", "n", "windows", "pairs", "lines", "common", "lang")]
    either = lambda k: F.array_remove(F.array_remove("words", F.get("common", F.lit(k))), F.initcap(F.get("common", F.lit(k))))
    rows = rows.select(
        *names, group_key(F.col("lang")).alias("lang_key"), F.col("n").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"), F.length("text").cast("long").alias("n_chars"),
        count(SYMBOLS).alias("n_symbols"), *[count(p).alias(f"n_{c}") for c, p in CHAR_CLASSES.items()],
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.expr(words_in).alias("n_repeat_words"),
        *[F.coalesce(F.col("n") - F.size(either(k)), F.lit(0)).cast("long").alias(f"n_common{k}") for k in range(8)])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.select(
        "*", failed.alias("base_failed"), (F.col("n_chars") - F.col("word_chars")).alias("n_spaces"),
        (F.col("word_chars") - F.col("n_symbols") - F.col("n_upper") - F.col("n_digits") - F.col("n_marks")).alias("n_others"),
        (F.col("n_words") - sum(F.col(c) for c in WORDS[:-1])).alias("n_rare"))


def references(rows: DataFrame) -> DataFrame:
    """One histogram per language over all documents that pass the base rules: a sum with map-side combine."""
    # No filter: one that is pushed below the counts would compute them over and over.
    good = lambda c: F.sum(F.when(~F.col("base_failed"), F.col(c)))
    refs = rows.groupBy("lang_key").agg(good("n_words").alias("ref_words"), *[good(c).cast("double").alias(c) for c in (*CHARS, *WORDS)])
    return refs.select("lang_key", "ref_words", F.array(*CHARS).alias("ref_chars"), F.array(*WORDS).alias("ref_common"))


def divergence(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2, from 0 to 1) of two arrays of counts; 0 where one has no counts."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    shares = lambda a: F.transform(a, lambda x: x / F.greatest(total(a), F.lit(1.0)))
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(shares(p), shares(q), lambda x, y: (part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(total(terms), F.lit(0.0)))).otherwise(0.0)


def judged(rows: DataFrame, refs: DataFrame, *, max_chars: float = 0.3, max_common: float = 0.23, min_words: int = 100, min_common: int = 200,
           min_reference: int = 1000) -> DataFrame:
    """Add ``js_chars``, ``js_common`` and ``kept`` to measured rows.

    A document is rejected if it fails the base rules or a distance is above its limit. Distances count
    only from ``min_words`` (characters) and ``min_common`` (common words) words on, and only against
    languages of ``min_reference`` words; others pass. A null language is a language of its own; a
    language without a word list is judged by its characters alone.
    """
    known = rows.join(refs, "lang_key", "left")
    known = known.withColumn("js_chars", divergence(F.array(*[F.col(c).cast("double") for c in CHARS]), F.col("ref_chars")))
    known = known.withColumn("js_common", divergence(F.array(*[F.col(c).cast("double") for c in WORDS]), F.col("ref_common")))
    enough = F.coalesce(F.col("ref_words"), F.lit(0)) >= min_reference
    far = ((F.col("n_words") >= min_words) & (F.col("js_chars") > max_chars)) | ((F.col("n_words") >= min_common) & (F.col("js_common") > max_common))
    # A sum of values that cannot be null, so that no part of it is pushed below the counts as a filter of its own.
    against = F.coalesce(F.col("base_failed"), F.lit(True)).cast("int") + (enough & F.coalesce(far, F.lit(False))).cast("int")
    return known.withColumn("kept", against == 0)


def checked(docs: DataFrame, refs: DataFrame | None = None, **options) -> DataFrame:
    """The rules' counts and verdict per row; texts are read once and only counts are stored.

    ``refs`` is a table of ``references`` made from trusted texts; without it the table's own documents that
    pass the base rules are the reference. Rows that repeat are judged alike; other columns are not read; an
    empty table gives an empty result.
    """
    keep = Stored(docs.sparkSession)
    rows = keep(measured(docs, **options))
    return judged(rows, keep(references(rows)) if refs is None else refs)


def passing(docs: DataFrame, refs: DataFrame | None = None, **options) -> DataFrame:
    """The documents (all columns) that pass, without a shuffle of texts: they are measured again instead. ``refs`` as for ``checked``."""
    if refs is None:
        refs = Stored(docs.sparkSession)(references(measured(docs, **options)))
    return judged(measured(docs, F.struct("*").alias("_row"), **options), refs).filter("kept").select("_row.*")


def sql(max_chars: float = 0.3, max_common: float = 0.23, min_words: int = 100, min_common: int = 200, min_reference: int = 1000) -> str:
    """The base counts and the verdict for DuckDB, by unnesting words, windows and lines."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    common = ", ".join(f"({q('=' + lang)}, {k}, {q(v)})" for lang, ws in COMMON_WORDS.items() for k, w in enumerate(ws) for v in (w, w[0].upper() + w[1:]))
    drop = lambda p: f"length(tx) - length(regexp_replace(tx, {q(p)}, '', 'g'))"
    js = lambda cols: "sqrt(greatest(" + " + ".join(
        f"(case when p_{c} > 0 then p_{c} * log2(p_{c} / ((p_{c} + q_{c}) / 2)) else 0 end + case when q_{c} > 0 then q_{c} * log2(q_{c} / ((p_{c} + q_{c}) / 2)) else 0 end) / 2"
        for c in cols) + ", 0))"
    share = lambda side, total, cols, name: ", ".join(f"{side}.{c}::double / greatest({total}, 1) as {name}_{c}" for c in cols)
    kinds = ", ".join(f"count(*) filter (k = {k}) n_common{k}" for k in range(8))
    sums = ", ".join(f"sum({c}) {c}" for c in (*CHARS, *WORDS))
    return f"""
with d as (select row_number() over () rid, doc_id, case when lang is null then '' else '=' || lang end lang_key, coalesce(text, '') tx,
  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') ws from documents),
w as (select rid, lang_key, unnest(ws) w, generate_subscripts(ws, 1) i from d),
t as (select rid, i, count(*) over (partition by rid, w, w2, w3) n from (select rid, i, w, lead(w) over (partition by rid order by i) w2, lead(w, 2) over (partition by rid order by i) w3 from w) where w3 is not null),
rep as (select rid, count(distinct p) n_repeat_words from (select rid, unnest([i, i + 1, i + 2]) p from t where n > 1) group by rid),
ln as (select rid, count(*) - count(distinct l) n_dup_lines from (select rid, unnest(string_split(tx, chr(10))) l from d) where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by rid),
common(lang_key, k, v) as (values {common}),
cw as (select rid, {kinds} from w join common on w.lang_key = common.lang_key and w.w = common.v group by rid),
m as (select d.rid, doc_id, lang_key, len(ws)::bigint n_words, length(array_to_string(ws, ''))::bigint word_chars, length(tx) - length(array_to_string(ws, '')) n_spaces,
  ({drop(SYMBOLS)})::bigint n_symbols, {', '.join(f'{drop(p)} n_{c}' for c, p in CHAR_CLASSES.items())},
  coalesce(n_dup_lines, 0)::bigint n_dup_lines, coalesce(n_repeat_words, 0)::bigint n_repeat_words, {', '.join(f'coalesce(n_common{k}, 0) n_common{k}' for k in range(8))}
  from d left join rep using (rid) left join ln using (rid) left join cw using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, word_chars - n_symbols - n_upper - n_digits - n_marks n_others,
  n_words - ({' + '.join(WORDS[:-1])}) n_rare from m),
r as (select lang_key, sum(n_words) ref_words, {sums} from f where not base_failed group by lang_key),
s as (select f.rid, ref_words, {share('f', 'f.n_spaces + f.word_chars', CHARS, 'p')}, {share('f', 'f.n_words', WORDS, 'p')},
  {share('r', ' + '.join('r.' + c for c in CHARS), CHARS, 'q')}, {share('r', 'r.ref_words', WORDS, 'q')} from f join r using (lang_key))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(ref_words >= {min_reference} and ((n_words >= {min_words} and {js(CHARS)} > {max_chars}) or (n_words >= {min_common} and {js(WORDS)} > {max_common})), false) as kept
from f left join s using (rid)"""
