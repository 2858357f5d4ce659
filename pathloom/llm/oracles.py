"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from pathloom.llm import license_scan

_SPLIT = r"[\x00-/:-@\[-`{-\x7F]+"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex(lower(coalesce({text}, '')), '{_SPLIT}'), lambda x: x <> '')"


def license_sql(templates: tuple[license_scan.Template, ...] = license_scan.BASE + license_scan.NOTICES + license_scan.TEXTS) -> str:
    """For each template: the places of its key phrase, and the IDF mass of its words that stand where they belong."""
    vocabulary = sorted({w for t in templates for w in t.words.split()})
    listed = ", ".join(f"'{w}'" for w in vocabulary)
    found = []
    for n, t in enumerate(templates):
        words, key = t.words.split(), t.key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(key)] == key)
        here = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(key))
        texts = ", ".join(f"'{x}'" for x in words)
        mass = f"(SELECT list_sum(list_transform([{texts}], lambda x: m[x])) FROM idfs)"
        in_place = f"list_sum(list_transform(range(1, {len(words) + 1}), lambda k: CASE WHEN i + k - {at + 1} >= 1 AND w[greatest(i + k - {at + 1}, 1)] = ([{texts}])[k] THEN m[([{texts}])[k]] ELSE 0 END))"
        found.append(
            f"SELECT doc_id, i - 1 AS start, '{t.label}' AS label, {str(t.base).lower()} AS base, least({in_place} / {mass}, 1.0) AS score, {t.least} AS least"
            f" FROM (SELECT doc_id, w, unnest(list_filter(range(1, len(w) + 1), lambda i: {here})) AS i FROM docs) p{n}, idfs"
        )
    return f"""WITH docs AS (SELECT doc_id, {_words("text")} AS w FROM documents),
df AS (SELECT word, count(*) AS n FROM (SELECT unnest(list_intersect(list_distinct(w), [{listed}])) AS word FROM docs) GROUP BY word),
idf AS (SELECT v.word, ln(((SELECT count(*) FROM docs) + 1)::DOUBLE / (coalesce(df.n, 0) + 1)) + 1 AS idf FROM (SELECT unnest([{listed}]) AS word) v LEFT JOIN df ON df.word = v.word),
idfs AS (SELECT map_from_entries(list((word, idf))) AS m FROM idf),
matches AS (SELECT * FROM ({" UNION ALL ".join(found)}) WHERE score >= least),
marks AS (SELECT doc_id, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(score) AS score FROM matches GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
 round(coalesce(score, 0)::DOUBLE, 9) AS score FROM docs d LEFT JOIN marks m ON m.doc_id = d.doc_id"""


def decontamination_sql() -> str:
    """The law without any seed: equal words of texts and items counted on each diagonal."""
    return f"""WITH docs AS (SELECT DISTINCT doc_id, md5(coalesce(text, '')) AS own, {_words("text")} AS w FROM documents), items AS (SELECT DISTINCT item_id, {_words("text")} AS w FROM benchmark),
dw AS (SELECT doc_id, own, unnest(w) AS x, unnest(range(len(w))) AS i FROM docs), iw AS (SELECT item_id, len(w) AS n, unnest(w) AS x, unnest(range(len(w))) AS i FROM items),
laid AS (SELECT d.doc_id, d.own, b.item_id, b.n, d.i - b.i AS start, count(*) AS overlap FROM dw d JOIN iw b ON d.x = b.x GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, own, item_id, n ORDER BY overlap DESC, start) AS rn FROM laid WHERE CASE WHEN n < 3 THEN overlap = n ELSE overlap::DOUBLE / n >= 0.5 OR overlap >= 13 END)
SELECT doc_id, item_id, start::BIGINT AS start, overlap::INT AS overlap, overlap::DOUBLE / n AS share FROM best WHERE rn = 1"""


ORACLES = {"op3_license_scan": license_sql(), "op6_spaced_seed_decontamination": decontamination_sql()}
