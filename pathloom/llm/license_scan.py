"""License scan by a positional index of rare words.

Each template is a licence text or phrase with a mandatory key phrase. Document frequencies of the templates' words over all
files give their IDF. A template has a posting (template, offset) under each of the words of its key phrase with the highest
IDF. A file's occurrences of such words are looked up; each gives the places where a template would start, and the places of
a template's rarest word are intersected with those of its other posted words, so that only words that stand at the right
distances from one another leave a candidate. There the key phrase is verified word by word, and the template's other words
are compared at their relative positions. Built of SQL functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pathloom.llm.common import free_name

#: Between words: ASCII but for digits and letters.
SEPARATORS = r"[\x00-/:-@\[-`{-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: str
    #: Key phrase: words of the template in a row that must all be there.
    key: str
    base: bool = False
    #: Least share of the template's IDF mass that must stand at its relative position.
    least: float = 0.0


#: The phrases of the base labels.
BASE = (
    Template("gpl", "gnu general public license", "gnu general public license", True),
    Template("apache", "apache license", "apache license", True),
    Template("cc-by", "cc by", "cc by", True),
    Template("mit", "mit license", "mit license", True),
)
#: Notices as their public texts have them; the method's own labels.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2", least=0.6),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", "general public license version 2", least=0.6),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", "general public license version 3", least=0.6),
    Template("lgpl", "gnu lesser general public license", "lesser general public license", least=0.6),
    Template("agpl", "gnu affero general public license", "affero general public license", least=0.6),
    Template("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "free software you can redistribute it", least=0.6),
    Template("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge", least=0.6),
    Template("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms", least=0.6),
    Template("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license", least=0.6),
    Template("cc-by-nc", "licensed under cc by nc", "cc by nc", least=0.6),
    Template("cc-by-sa", "licensed under cc by sa", "cc by sa", least=0.6),
    Template("cc-by-nd", "licensed under cc by nd", "cc by nd", least=0.6),
)
#: Whole licence texts, without names and years.
TEXTS = (
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with "
        "the software or the use or other dealings in the software",
        "to deal in the software without restriction",
        least=0.8,
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "for any purpose with or without fee",
        least=0.8,
    ),
    Template(
        "bsd-2-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "redistributions of source code must retain",
        least=0.8,
    ),
    Template(
        "apache-2.0-text",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "except in compliance with the license",
        least=0.8,
    ),
)
#: So many words of a key phrase have postings.
POSTED = 3


def word_array(text: Column) -> Column:
    """The text's words as they are written, after an empty first one if the text begins with a separator, before an empty last one if it ends so."""
    return F.split(text, SEPARATORS)


def _first(words: Column) -> Column:
    return (F.get(words, F.lit(0)) == "").cast("int")


def word_count(words: Column) -> Column:
    return F.size(words) - _first(words) - F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)


def inverse_frequencies(docs: DataFrame, templates: tuple[Template, ...]) -> dict[str, float]:
    """ln((n + 1) / (df + 1)) + 1 of every word in the templates, over all files; the result is as small as that vocabulary."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    words = F.array_intersect(F.split(F.lower(F.coalesce(F.col("text"), F.lit(""))), SEPARATORS), F.array(*map(F.lit, vocabulary)))
    rows = docs.select(F.explode(F.array_append(words, F.lit(""))).alias("w")).groupBy("w").count().collect()
    # the empty word, appended to each file's, may also be among them: array_intersect never gives it
    df = {r.w: r["count"] for r in rows}
    n = df.pop("", 0)
    return {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in vocabulary}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES + TEXTS) -> DataFrame:
    """docs with n_words, matches (of each verified place: label, base, start word, end word, score) sorted by start.

    Words are runs of digits, letters and characters beyond ASCII; A-Z count as a-z. A null text has no words. Files
    without any licence word get an empty array; columns named n_words or matches are replaced."""
    idf = inverse_frequencies(docs, templates)
    split, entries, postings = free_name(docs, "_words"), [], [{} for _ in range(POSTED)]
    for t, template in enumerate(templates):
        words, key = template.words.split(), template.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        rare = sorted(range(len(key)), key=lambda i: (-idf[key[i]], i))[:POSTED]
        for listed, i in zip(postings, rare + rare[-1:] * (POSTED - len(rare)), strict=True):
            listed.setdefault(key[i], []).append((t, at + i))
        mass = sum(idf[w] for w in words)
        entries.append((template, words, at, len(key), [idf[w] / mass for w in words]))

    rare_words = sorted(postings[0])
    posted = sorted(set().union(*postings))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.drop("n_words", "matches").withColumn(split, word_array(text)).withColumn("n_words", word_count(F.col(split)).cast("long"))
    maybe = text.rlike("(?i)" + "|".join(rare_words))
    occurrences = F.filter(F.transform(F.col(split), lambda w, i: F.struct(i.alias("i"), F.lower(w).alias("w"))), lambda o: o.w.isin(posted))
    texts = F.array(*(F.struct(F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), F.array(*map(F.lit, words)).alias("words"), F.lit(at).alias("at"), F.lit(n).alias("n"), F.array(*map(F.lit, shares)).alias("shares"), F.lit(t.least).alias("least")) for t, words, at, n, shares in entries))
    longest = max(len(e[1]) for e in entries)

    def places(found: Column, listed: dict[str, list[tuple[int, int]]]) -> Column:
        """Where templates would start by the words listed, as longs of template and place."""
        index = F.create_map(*(x for w in sorted(listed) for x in (F.lit(w), F.array(*(F.lit((t << 40) + longest - o) for t, o in listed[w])))))
        here = lambda o: F.transform(F.coalesce(F.element_at(index, o.w), F.expr("CAST(array() AS array<bigint>)")), lambda p: p + o.i)
        return F.flatten(F.transform(found, here))

    def intersected(found: Column) -> Column:
        kept = places(found, postings[0])
        for listed in postings[1:]:
            kept = F.array_intersect(kept, places(found, listed))
        return F.transform(kept, lambda c: F.struct((c.bitwiseAND(F.lit((1 << 40) - 1)) - longest).cast("int").alias("start"), F.shiftright(c, 40).cast("int").alias("t")))

    def looked(c: Column) -> Column:
        t = F.get(texts, c.t)
        here = F.transform(t.words, lambda w, k: F.coalesce(F.lower(F.get(F.col(split), F.when(c.start + k >= 0, c.start + k))) == w, F.lit(False)))
        score = F.aggregate(F.zip_with(here, t.shares, lambda h, s: F.when(h, s).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        key = F.forall(F.slice(here, t.at + 1, t.n), lambda h: h)
        return F.struct((c.start + t.at - _first(F.col(split))).cast("long").alias("start"), t.label.alias("label"), t.base.alias("base"), F.least(score, F.lit(1.0)).alias("score"), (key & (score >= t.least)).alias("good"))

    # the lambda's variable holds the occurrences, which are looked for once
    candidates = F.get(F.transform(F.array(occurrences), intersected), F.lit(0))
    found = F.filter(F.transform(candidates, looked), lambda m: m.good)
    kept = F.array_sort(F.transform(found, lambda m: F.struct(m.start.alias("start"), m.label.alias("label"), m.base.alias("base"), m.score.alias("score"))))
    return rows.withColumn("matches", F.when(maybe, kept).otherwise(F.expr("CAST(array() AS array<struct<start:bigint,label:string,base:boolean,score:double>>)"))).drop(split)


def summarized(matches: Column) -> dict[str, Column]:
    """n_base, first_word, last_word, base_labels, labels and score of the matches of one file."""
    base = F.filter(matches, lambda m: m.base)
    starts = F.transform(base, lambda m: m.start)

    def joined(found: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda m: m.label))), ",")

    return {"n_base": F.size(base).cast("long"), "first_word": F.array_min(starts), "last_word": F.array_max(starts), "base_labels": joined(base), "labels": joined(matches), "score": F.coalesce(F.array_max(F.transform(matches, lambda m: m.score)), F.lit(0.0))}
