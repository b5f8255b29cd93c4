"""License scan by a positional index of rare words, in column functions only.

Each template (a phrase or notice) is indexed under the rarest words of its mandatory phrases. A text's words
that the index holds lead to postings (template, offset), and a template's postings that agree on where it
starts are intersected. At the starts that all of them share the mandatory phrases are verified word by
word, and the template's other words are weighed by how many stand in place.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from propspark.llm.common import LOWER, UPPER, text_of

#: A run of ASCII digits, lower-case letters and all characters beyond ASCII.
WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    """A notice; the parts in square brackets are mandatory, all else adds to the score."""

    label: str
    notice: str
    base: bool = False

    def parts(self) -> tuple[list[str], list[tuple[int, list[str]]]]:
        words: list[str] = []
        phrases = []
        for i, part in enumerate(re.split(r"[\[\]]", self.notice)):
            own = part.split()
            if i % 2:
                phrases.append((len(words), own))
            words += own
        return words, phrases


#: Phrases and labels that are fixed values.
BASE = (
    Template("gpl", "[gnu general public license]", True),
    Template("apache", "[apache license]", True),
    Template("cc-by", "[cc by]", True),
    Template("mit", "[mit license]", True),
)
#: Labels of this scan's own: what well-known notices begin with or are recognised by.
NOTICES = (
    Template("apache-2.0", "licensed under the [apache license version 2 0] the license you may not use this file except in compliance with the license"),
    Template("apache-1.1", "this product includes software developed by the [apache software foundation] http www apache org"),
    Template("gpl-2.0", "under the terms of the [gnu general public license version 2]"),
    Template("gpl-3.0", "under the terms of the [gnu general public license version 3]"),
    Template("gpl-or-later", "it under the terms of the [gnu general public license as published by the free software foundation either version] 2 of the license "
             "or at your option any later version"),
    Template("lgpl", "under the terms of the [gnu lesser general public license] as published by the free software foundation"),
    Template("lgpl-library", "under the terms of the [gnu library general public license] as published by the free software foundation"),
    Template("agpl", "under the terms of the [gnu affero general public license] as published by the free software foundation"),
    Template("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the [gnu free documentation license] version"),
    Template("mit-text", "[permission is hereby granted free of charge to any person obtaining a copy] of this software and associated documentation files "
             "the software to deal in the software without restriction"),
    Template("bsd", "[redistribution and use in source and binary forms] with or without modification are [permitted provided that the following conditions are met]"),
    Template("bsd-3-clause", "[neither the name of] the copyright holder nor the names of its contributors may be used to [endorse or promote products derived from this software]"),
    Template("bsd-4-clause", "[all advertising materials mentioning features or use of this software must display the following acknowledgement]"),
    Template("isc", "[permission to use copy modify and or distribute this software] for any purpose with or without fee is hereby granted"),
    Template("zlib", "[this software is provided as is without any express or implied warranty] in no event will the authors be held liable for any damages arising from the use of this software"),
    Template("mpl-2.0", "this source code form is subject to the terms of the [mozilla public license v 2 0]"),
    Template("mpl-1.1", "the contents of this file are subject to the [mozilla public license version 1 1]"),
    Template("epl", "made available under the terms of the [eclipse public license]"),
    Template("cddl", "the contents of this file are subject to the terms of the [common development and distribution license]"),
    Template("cpl", "made available under the terms of the [common public license]"),
    Template("eupl", "licensed under the [european union public licence]"),
    Template("artistic-2.0", "this program is free software you can redistribute it and or modify it under the terms of the [artistic license 2 0]"),
    Template("ms-pl", "licensed under the [microsoft public license]"),
    Template("ms-rl", "licensed under the [microsoft reciprocal license]"),
    Template("osl", "licensed under the [open software license] version 3 0"),
    Template("afl", "licensed under the [academic free license] version 3 0"),
    Template("ofl", "this font software is licensed under the [sil open font license]"),
    Template("python", "licensed under the [python software foundation license]"),
    Template("postgresql", "[permission to use copy modify and distribute this software and its documentation] for any purpose without fee and without a written agreement is hereby granted"),
    Template("ncsa", "[university of illinois ncsa open source license]"),
    Template("openssl", "this product includes software developed by the [openssl project] for use in the openssl toolkit"),
    Template("php", "this source file is subject to version 3 01 of the [php license]"),
    Template("zpl", "this software is subject to the provisions of the [zope public license]"),
    Template("wtfpl", "[do what the fuck you want to public license]"),
    Template("unlicense", "this is [free and unencumbered software released into the public domain]"),
    Template("cc-by-nc", "licensed under [cc by nc] 4 0"),
    Template("cc-by-sa", "licensed under [cc by sa] 4 0"),
    Template("cc-by-nd", "licensed under [cc by nd] 4 0"),
    Template("cc-attribution", "licensed under a [creative commons attribution] 4 0 international license"),
    Template("cc0", "[cc0 1 0 universal] public domain dedication"),
    Template("odbl", "this database is made available under the [open database license]"),
    Template("boost", "[boost software license] version 1 0"),
)
#: Mandatory words that index a template: the rarest ones, all where there are fewer.
RARE_WORDS = 3


def index(templates: Sequence[Template], rare: int = RARE_WORDS) -> tuple[list[dict], dict[str, list[dict]]]:
    """Facts of each template, and postings: each of its ``rare`` rarest mandatory words with template and offset.

    A word's rarity is its inverse document frequency over the templates; of equally rare ones the first counts.
    """
    parts = [t.parts() for t in templates]
    held: dict[str, int] = {}
    for words, _ in parts:
        for w in set(words):
            held[w] = held.get(w, 0) + 1
    idf = {w: math.log(1 + len(templates) / n) for w, n in held.items()}
    facts, postings = [], {}
    for k, (t, (words, phrases)) in enumerate(zip(templates, parts)):
        if not phrases:
            raise ValueError(f"{t.label} has no mandatory phrase")
        mandatory = [o + i for o, p in phrases for i in range(len(p))]
        chosen = sorted(mandatory, key=lambda i: (-idf[words[i]], i))[:rare]
        for off in chosen:
            postings.setdefault(words[off], []).append({"t": k, "off": off})
        facts.append({
            "label": t.label, "base": t.base, "rare": len(chosen), "main": phrases[0][0], "total": sum(idf[w] for w in words),
            "words": [{"off": i, "word": w, "idf": idf[w]} for i, w in enumerate(words)],
            "phrases": [{"off": o, "words": p} for o, p in phrases]})
    return facts, postings


FACTS_TYPE = ("array<struct<label string, base boolean, rare int, main int, total double, "
              "words array<struct<off int, word string, idf double>>, phrases array<struct<off int, words array<string>>>>>")
POSTINGS_TYPE = "map<string, array<struct<t int, off int>>>"


def scanned(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``matches`` (label, base, start, score of every place, in text order) and the derived columns.

    ``n_base``, ``first_word`` and ``last_word`` count and bound the places of base templates (null without
    any), ``base_labels`` and ``labels`` are distinct, sorted and joined by commas, ``score`` is the largest
    share of a found template's words, by rarity, that stand in place (0 without any).

    Whole texts are scanned, whatever their length; a null text is empty. Nothing is shuffled. The index is
    a constant of the templates, whose number does not depend on the data.
    """
    facts, postings = index(templates)
    table, where = F.from_json(F.lit(json.dumps(facts)), FACTS_TYPE), F.from_json(F.lit(json.dumps(postings)), POSTINGS_TYPE)
    words = F.regexp_extract_all(F.translate(text_of(text_col), UPPER, LOWER), F.lit(WORD), F.lit(0))
    rows = docs.select(F.col(id_col).alias("doc_id"), words.alias("words"))
    # The text's index words with their positions lead to (template, start); a start that all of a template's
    # postings share stands there as often, next to itself once sorted.
    seen = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: x.w.isin(sorted(postings)))
    rows = rows.withColumn("seen", F.when(F.arrays_overlap("words", F.array(*map(F.lit, sorted(postings)))), seen))
    starts = F.flatten(F.transform("seen", lambda x: F.transform(F.element_at(where, x.w), lambda p: F.struct(p.t.alias("t"), (x.i - p.off).alias("start")))))
    rows = rows.withColumn("starts", F.array_sort(starts))
    rare = F.array(*[F.lit(f["rare"]) for f in facts])
    shared = F.filter("starts", lambda s, i: F.get("starts", i + F.get(rare, s.t) - 1).eqNullSafe(s))
    rows = rows.withColumn("shared", F.transform(shared, lambda s: F.struct(F.get(table, s.t).alias("of"), s.start.alias("start"))))

    def stands(x: Column) -> Column:
        # A text may begin inside a notice, but not inside a mandatory phrase.
        whole = lambda p: F.when(x.start + p.off >= 0, F.slice("words", x.start + p.off + 1, F.size(p.words)) == p.words).otherwise(False)
        return F.forall(x.of.phrases, whole)

    def score(x: Column) -> Column:
        held = F.aggregate(x.of.words, F.lit(0.0), lambda s, p: s + F.when(F.get("words", x.start + p.off) == p.word, p.idf).otherwise(0.0))
        return F.least(held / x.of.total, F.lit(1.0))

    found = F.transform(F.filter("shared", stands), lambda x: F.struct(
        x.of.label.alias("label"), x.of.base.alias("base"), (x.start + x.of.main).alias("start"), score(x).alias("score")))
    found = F.coalesce(found, F.array().cast("array<struct<label string, base boolean, start int, score double>>"))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), F.array_sort(found, lambda a, b: F.coalesce(
        *[F.when(a[k] < b[k], -1).when(a[k] > b[k], 1) for k in ("start", "label")], F.lit(0))).alias("matches"))
    base = F.filter("matches", lambda m: m.base)
    joined = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m.label))), ",")
    return rows.withColumn("base_matches", base).select(
        "doc_id", "n_words", "matches", F.size("base_matches").cast("long").alias("n_base"),
        F.array_min(F.transform("base_matches", lambda m: m.start)).cast("long").alias("first_word"),
        F.array_max(F.transform("base_matches", lambda m: m.start)).cast("long").alias("last_word"),
        joined(F.col("base_matches")).alias("base_labels"), joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m.score)), F.lit(0.0)).alias("score"))


def sql(templates: Sequence[Template] = BASE + NOTICES) -> str:
    """The same result for DuckDB: postings are joined to all words and grouped by text, template and start."""
    rows, _ = index(templates)
    quote = lambda s: "'" + s + "'"
    post = ", ".join(f"({k}, {p['off']}, {quote(p['word'])}, {p['idf']!r}::double)" for k, r in enumerate(rows) for p in r["words"])
    need = ", ".join(f"({k}, {p['off'] + i}, {quote(w)})" for k, r in enumerate(rows) for p in r["phrases"] for i, w in enumerate(p["words"]))
    temp = ", ".join(f"({k}, {quote(r['label'])}, {str(r['base']).lower()}, {r['main']}, {r['total']!r}::double, {sum(len(p['words']) for p in r['phrases'])})"
                     for k, r in enumerate(rows))
    return f"""
with d as (select row_number() over () rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') ws from documents),
post(t, off, w, idf) as (values {post}),
need(t, off, w) as (values {need}),
temp(t, label, base, main, total, n) as (values {temp}),
wp as (select rid, unnest(ws) w, generate_subscripts(ws, 1) - 1 as pos from d),
ok as (select rid, need.t, wp.pos - off as st from wp join need on wp.w = need.w join temp on temp.t = need.t
       group by rid, need.t, wp.pos - off, n having count(*) = n),
m as (select ok.rid, ok.t, st, label, base, main, least(sum(idf) / total, 1.0) score from ok join temp on temp.t = ok.t
      join post on post.t = ok.t join wp on wp.rid = ok.rid and wp.w = post.w and wp.pos = st + off group by ok.rid, ok.t, st, label, base, main, total),
g as (select rid, count(*) filter (base) n_base, min(st + main) filter (base) first_word, max(st + main) filter (base) last_word,
      string_agg(distinct label, ',' order by label) filter (base) base_labels, string_agg(distinct label, ',' order by label) labels, max(score) score from m group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_base, 0)::bigint n_base, first_word::bigint first_word, last_word::bigint last_word,
  coalesce(base_labels, '') base_labels, coalesce(labels, '') labels, round(coalesce(score, 0), 6) score
from d left join g using (rid)"""
