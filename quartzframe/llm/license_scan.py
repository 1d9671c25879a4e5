"""License scans: exact set-similarity join of text blocks with license templates, in DataFrame expressions only.

A block is any run of words of a template's length (``slack`` times its words), wherever lines break. It matches if it
holds at least ``threshold`` of the template's distinct tokens, and all tokens that tell the template from similar ones
of another label.

1. The template tokens of every document are gathered once. Their document frequencies order tokens globally, rare ones
   first, with ties by the token.
2. Prefix filter: a block that misses at most |T| - need of a template's tokens holds one of its |T| - need + 1 rarest.
   Documents meet templates only by such tokens.
3. Length filter: documents with fewer than need tokens in common with the template go. Positional filter: with the
   first common token at places i and j of both orders, at most 1 + min(tokens left in either) can be common.
4. In the texts that are left, each once, the distinct tokens of every block that starts with one are counted exactly,
   by a sliding window over the template's words.
The template side is a fixed list, so it alone is broadcast. Texts that are left are found by a join on their key, where
only rows that a filter of a fixed size lets pass are shuffled (``common.join_filtered``).

Base labels come from phrases whose words stand consecutively. They are found by one pattern each on the whole text;
only ASCII letters are folded.

Rows: a null text is an empty one: no words, no labels, score 0. A null doc_id is kept. Repeated rows give a row each.
Texts are searched whole, whatever their length. An empty table gives no rows. Extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quartzframe.llm import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words before A-Z are lowered.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_IN, _OUT = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Statements as they are commonly put into texts, and paragraphs of the usual notices, with their labels.
TEMPLATES = (
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "licensed under the gnu affero general public license"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd", "released under the bsd license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("all-rights-reserved", "all rights reserved"),
)
THRESHOLD = 0.8
#: Words of a block, as a multiple of the template's words.
SLACK = 1.25


#: What only equal texts share.
KEYS = ["text_hash", "text_length"]


def _keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias(KEYS[0]), F.coalesce(F.length(text), F.lit(-1)).alias(KEYS[1])]


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _strings(values) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def _phrase(phrase: str) -> str:
    return f"(?<!{_IN})" + f"{_OUT}+".join(phrase.split()) + f"(?!{_IN})"


_ANY_PHRASE = "(?i)(?:" + "|".join(map(_phrase, PHRASES)) + ")"


def _words_before(text: Column, pattern: str) -> Column:
    """Words before the place where pattern, that captures what precedes it, ends its first group."""
    return F.regexp_count(F.regexp_extract(text, pattern, 1), F.lit(RAW_WORD)).cast("long")


def base(docs: DataFrame) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word and base_found (array of labels)."""
    text = F.coalesce("text", F.lit(""))
    has = text.rlike(_ANY_PHRASE)
    count = lambda p: F.regexp_count(text, F.lit(f"(?i){_phrase(p)}"))
    labels = F.filter(F.array(*(F.when(text.rlike(f"(?i){_phrase(p)}"), F.lit(label)) for p, label in PHRASES.items())), lambda x: x.isNotNull())
    return docs.withColumns({
        "n_words": F.regexp_count(text, F.lit(RAW_WORD)).cast("long"),
        "n_base": F.when(has, reduce(Column.__add__, map(count, PHRASES))).otherwise(0).cast("long"),
        "first_word": F.when(has, _words_before(text, "(?s)^(.*?)" + _ANY_PHRASE)),
        "last_word": F.when(has, _words_before(text, "(?s)^(.*)" + _ANY_PHRASE)),
        "base_found": F.when(has, F.array_distinct(labels)).otherwise(F.array().cast("array<string>")),
    })


class Index:
    """Templates in the global token order, with what the filters need of each."""

    def __init__(self, frequencies: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD, slack: float = SLACK):
        self.order = sorted(frequencies, key=lambda t: (frequencies[t], t))
        place = {t: i for i, t in enumerate(self.order)}
        self.templates = []
        for number, row in enumerate(rules(templates, threshold, slack)):
            tokens = sorted(row["tokens"], key=place.__getitem__)
            prefix = tokens[: len(tokens) - row["need"] + 1]
            self.templates.append((number, row["label"], tokens, prefix, row["telling"], row["need"], row["span"]))
        self.least = min((t[5] for t in self.templates), default=1)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.templates, "template int, label string, t_tokens array<string>, t_prefix array<string>, telling array<string>, need int, span int")


def rules(templates=TEMPLATES, threshold: float = THRESHOLD, slack: float = SLACK) -> list[dict]:
    """Of each template: label, tokens (distinct), need (how many of them), span (words of a block), and telling: the
    tokens that a template of another label lacks which else would meet this one's threshold."""
    sets = [(label, set(text.split())) for label, text in templates]
    out = []
    for (label, tokens), (_, text) in zip(sets, templates, strict=True):
        need = math.ceil(round(threshold * len(tokens), 9))
        telling = {t for other, has in sets if other != label and len(tokens & has) >= need for t in tokens - has}
        out.append({"label": label, "tokens": sorted(tokens), "need": need, "span": math.ceil(round(slack * len(text.split()), 9)), "telling": sorted(telling)})
    return out


def _words(text: Column) -> Column:
    return F.split(lowered(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def candidates(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, slack: float = SLACK) -> tuple[DataFrame, Index]:
    """KEYS, n (rows) and template of the texts that pass the filters; and the index."""
    tokens = sorted({t for _, text in templates for t in text.split()})
    own = docs.where("text IS NOT NULL").select(*_keys(F.col("text")), F.array_intersect(_words(F.col("text")), _strings(tokens)).alias("own"))
    own = common.materialize(own.where(F.size("own") > 0), "license-tokens")
    # as many counts as there are tokens, whatever the corpus
    counts = own.select(F.explode("own").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect()
    index = Index({t: 0 for t in tokens} | {r["token"]: r["n"] for r in counts}, templates, threshold, slack)
    table = index.table(docs.sparkSession)
    ordered = own.where(F.size("own") >= index.least).groupBy(*KEYS).agg(F.first("own").alias("own"), F.count(F.lit(1)).alias("n")).select(*KEYS, "n", F.array_intersect(_strings(index.order), "own").alias("own"))
    prefixes = table.select("template", "t_tokens", "need", F.posexplode("t_prefix").alias("t_at", "t_token"))
    rows = ordered.select("*", F.posexplode("own").alias("at", "token"))
    pairs = rows.join(F.broadcast(prefixes), F.col("token") == F.col("t_token"))
    possible = 1 + F.least(F.size("own") - F.col("at") - 1, F.size("t_tokens") - F.col("t_at") - 1)
    # with an earlier common token more would be possible, so the first one decides; a pair's other rows say less
    enough = pairs.where((possible >= F.col("need")) & (F.size(F.array_intersect("own", "t_tokens")) >= F.col("need")))
    return enough.select(*KEYS, "n", "template").distinct(), index


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """KEYS, template (its number), label, first_word and containment of every block and template that match; of
    blocks that differ only in words outside the template the one that starts with one of its words."""
    found, index = candidates(docs, templates, threshold, slack)
    found = common.materialize(found.groupBy(*KEYS, "n").agg(F.collect_set("template").alias("template")), "license-candidates")
    texts = common.join_filtered(docs.select(*_keys(F.col("text")), "text"), found, KEYS).dropDuplicates(KEYS).select(*KEYS, "text", F.explode("template").alias("template"))
    rows = texts.join(F.broadcast(index.table(docs.sparkSession)), "template")
    words = F.regexp_extract_all(lowered(F.col("text")), F.lit(WORD), F.lit(0))
    placed = F.transform(words, lambda w, i: F.struct(i.alias("at"), w.alias("word")))
    rows = rows.select(*KEYS, "template", "label", "t_tokens", "telling", "need", "span", F.filter(placed, lambda x: F.array_contains("t_tokens", x["word"])).alias("hits"))
    hits = rows.select(*KEYS, "template", "label", "t_tokens", "telling", "need", "span", F.inline("hits"))
    # words less than span apart: at least half a word below and above 1
    order = F.col("at") / (F.col("span") - 0.5)
    held = F.collect_set("word").over(Window.partitionBy(*KEYS, "template").orderBy(order).rangeBetween(Window.currentRow, 1))
    blocks = hits.withColumn("held", held).where((F.size("held") >= F.col("need")) & (F.size(F.array_except("telling", "held")) == 0))
    return blocks.select(*KEYS, "template", "label", F.col("at").cast("long").alias("first_word"), (F.size("held") / F.size("t_tokens")).alias("containment"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, slack: float = SLACK) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score (greatest containment of a block,
    1 where a base phrase stands, else 0) of every row."""
    docs = docs.select("doc_id", "text")
    found = matches(docs, templates, threshold, slack).groupBy(*KEYS).agg(F.collect_set("label").alias("found"), F.max("containment").alias("containment"))
    figures = common.materialize(base(docs).select("*", *_keys(F.col("text"))).drop("text"), "license-figures")
    copies = figures.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    found = common.materialize(copies.join(found, KEYS), "licenses")
    joined = common.join_counted(figures, found, KEYS, "left")
    text_of = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    extra = F.coalesce("found", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", text_of(F.col("base_found")).alias("base_labels"),
        text_of(F.concat("base_found", extra)).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
