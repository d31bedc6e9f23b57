"""Queries of this package and, where SQL can say the same, their SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import contamination, mixing, neighbours, reading, terms
from tidelog.plans.catalog import NODES
from tidelog.session import table


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[(F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    t = table
    return {
        "p1_found": lambda s, d: terms.distinctive_terms(t(s, d, "postings"), t(s, d, "text_indexes")),
        "p1_log_entropy": lambda s, d: _rounded(
            terms.log_entropy(t(s, d, "postings"), t(s, d, "text_indexes")).select("ns", "doc_id", "term", "tf", "df", "gf", "entropy", "global_weight", "weight")
        ),
        "p1_top_terms": lambda s, d: terms.top_terms(t(s, d, "postings"), t(s, d, "text_indexes")),
        "p6_found": lambda s, d: neighbours.similar_pairs(t(s, d, "hnsw_nodes")),
        "p6_most_similar": lambda s, d: neighbours.most_similar(t(s, d, "hnsw_nodes")),
        "p7_found": lambda s, d: terms.useless_terms(t(s, d, "postings"), t(s, d, "text_indexes")),
        "p7_frequencies": lambda s, d: terms.marked_frequencies(t(s, d, "postings"), t(s, d, "text_indexes")),
        "p7_ngrams": lambda s, d: terms.ngram_frequencies(t(s, d, "postings"), 3),
        "p7_repeated": lambda s, d: terms.repeated_ngrams(t(s, d, "postings")).select("ns", "n", F.array_join("gram", "\u001f").alias("gram"), "total_tf", "df"),
        "p8_found": lambda s, d: contamination.contaminated(t(s, d, "documents"), t(s, d, "eval_items")),
        "p8_leaked_items": lambda s, d: contamination.leaked_items(t(s, d, "documents"), t(s, d, "eval_items")),
        "p9_mix": lambda s, d: mixing.mix(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_mix_report": lambda s, d: mixing.mix_report(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p9_mix_held": lambda s, d: mixing.mix_held(t(s, d, "documents"), t(s, d, "mix_targets")),
        "p10_found": lambda s, d: reading.demanding_documents(t(s, d, "documents")),
        "p10_measures": lambda s, d: _rounded(reading.text_measures(t(s, d, "documents")).drop("vocabulary")),
        "p10_reading_levels": lambda s, d: reading.reading_levels(t(s, d, "documents")),
        "p10_level_profile": lambda s, d: reading.level_profile(t(s, d, "documents")),
    }


_CURRENT = """
latest AS (SELECT ns, doc_id, max(coalesce(indexed_lsn, -1)) AS lsn FROM postings WHERE ns IS NOT NULL AND doc_id IS NOT NULL AND term IS NOT NULL GROUP BY ns, doc_id),
once AS (SELECT DISTINCT p.ns, p.doc_id, p.term, p.term_freq, p.doc_len_tokens, p.category, p.positions
         FROM postings p JOIN latest l ON p.ns = l.ns AND p.doc_id = l.doc_id AND coalesce(p.indexed_lsn, -1) = l.lsn WHERE p.term IS NOT NULL),
cur AS (SELECT ns, doc_id, lower(trim(term)) AS term, CAST(sum(coalesce(term_freq, len(positions), 0)) AS BIGINT) AS tf, max(doc_len_tokens) AS doc_len
        FROM once GROUP BY ns, doc_id, lower(trim(term))),
sizes AS (SELECT ns, arg_max(total_docs, coalesce(sidecar_lsn, -1)) AS total_docs FROM text_indexes GROUP BY ns),
spread AS (SELECT ns, term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS gf, sum(CASE WHEN tf > 0 THEN tf * ln(tf) ELSE 0 END) AS tlt FROM cur GROUP BY ns, term)
"""
#: Unit vectors of the usable rows: those of ``plans.catalog`` that aren't all zero, the newest of an id.
_UNITS = NODES.replace("WHERE list_count(v) = dims", "WHERE list_count(v) = dims AND list_max(list_transform(v, lambda x: abs(x))) > 0")
#: Text without fenced code, words, and sentences between marks.
_MEASURED = r"""lines_ AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS x FROM documents),
clean AS (SELECT doc_id, regexp_replace(x, '(?ms)^```[^\n]*(?:\n.*?(?:^```[^\n]*(?:\n|\z)|\z)|\z)', '', 'g') AS x FROM lines_),
marked AS (SELECT doc_id, x, regexp_replace(regexp_replace(regexp_replace(x, '(?m)^(#|- |\* |\d+[.)] )', chr(1) || '\1', 'g'), '[.!?]([\s\x0b\p{Z}\x85]|\z)', chr(1) || '\1', 'g'), '\n[ \t]*\n', chr(10) || chr(1) || chr(10), 'g') AS m FROM clean),
counted AS (SELECT doc_id, regexp_extract_all(x, '\p{L}+') AS w, len(regexp_extract_all(m, '\p{L}[^\x01]*')) AS sentences FROM marked),
measured AS (SELECT doc_id, CAST(length(array_to_string(w, '')) AS INTEGER) AS letters, CAST(len(w) AS INTEGER) AS words, CAST(sentences AS INTEGER) AS sentences FROM counted),
graded AS (SELECT *, CASE WHEN words > 0 THEN 4.71::DOUBLE * letters / words + 0.5::DOUBLE * words / sentences - 21.43::DOUBLE END AS grade FROM measured)"""
#: Full-width forms and ligatures with what they stand for. Fixed values.
_WIDE, _NARROW = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_JOINED = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "æ": "ae", "œ": "oe", "ß": "ss", "ø": "o", "ł": "l", "đ": "d", "ı": "i"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _words_sql(text: str) -> str:
    """Comparable words of a text."""
    out = f"regexp_replace({text}, '\\x{{AD}}[ \\t]*(\\r\\n?|\\n)[ \\t]*', '', 'g')"
    out = f"translate({out}, {_quoted(_WIDE)}, {_quoted(_NARROW)})"
    out = f"lower(strip_accents({out}))"
    for a, b in _JOINED.items():
        out = f"replace({out}, {_quoted(a)}, {_quoted(b)})"
    out = f"regexp_replace({out}, '[\\p{{Cf}}\\p{{Mn}}\\p{{Me}}]', '', 'g')"
    out = f"replace(replace({out}, chr(8208), '-'), chr(8209), '-')"
    out = f"regexp_replace({out}, '(?s)<!--.*?-->|</?[a-z][^<>]*>', '', 'g')"
    out = f"regexp_replace({out}, '\\]\\([^()\\s]*\\)', '', 'g')"
    out = f"regexp_replace({out}, '([\\p{{L}}\\p{{N}}])-[ \\t]*(\\r\\n?|\\n)[ \\t]*([\\p{{L}}\\p{{N}}])', '\\1\\3', 'g')"
    out = f"regexp_replace({out}, '([\\p{{L}}\\p{{N}}])[*`~]+([\\p{{L}}\\p{{N}}])', '\\1\\2', 'g')"
    return f"regexp_extract_all({out}, '[\\p{{L}}\\p{{N}}]+')"


def _grams_sql(table: str, key: str) -> str:
    return f"""SELECT DISTINCT {key}, array_to_string(w[i:i + 9], ' ') AS gram FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - 9)) AS i FROM (SELECT {key}, {_words_sql('text')} AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 10)"""




def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"""WITH {_CURRENT}
SELECT ns, doc_id, term FROM cur JOIN spread USING (ns, term) JOIN sizes USING (ns)
WHERE doc_len > 0 AND CAST(tf AS DOUBLE) / doc_len * ln(CAST(total_docs AS DOUBLE) / df) >= 0.6""",
        "p1_log_entropy": f"""WITH {_CURRENT},
weighted AS (SELECT ns, term, df, gf, total_docs, greatest(0.0, CASE WHEN gf > 0 THEN ln(gf) - tlt / gf ELSE 0.0 END) AS entropy FROM spread LEFT JOIN sizes USING (ns)),
global AS (SELECT *, CASE WHEN total_docs > 1 THEN greatest(0.0, least(1.0, 1 - entropy / ln(total_docs))) WHEN total_docs = 1 THEN 0.0 END AS global_weight FROM weighted)
SELECT ns, doc_id, term, tf, df, gf, round(entropy, 6) + 0.0 AS entropy, round(global_weight, 6) + 0.0 AS global_weight,
       round(ln(1.0 + tf) * global_weight, 6) + 0.0 AS weight
FROM cur JOIN global USING (ns, term)""",
        "p1_top_terms": f"""WITH {_CURRENT},
weighted AS (SELECT ns, term, total_docs, greatest(0.0, CASE WHEN gf > 0 THEN ln(gf) - tlt / gf ELSE 0.0 END) AS entropy FROM spread LEFT JOIN sizes USING (ns)),
global AS (SELECT *, CASE WHEN total_docs > 1 THEN greatest(0.0, least(1.0, 1 - entropy / ln(total_docs))) WHEN total_docs = 1 THEN 0.0 END AS global_weight FROM weighted),
rows_ AS (SELECT ns, doc_id, term, round(ln(1.0 + tf) * global_weight, 6) + 0.0 AS weight FROM cur JOIN global USING (ns, term))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ns, doc_id ORDER BY weight DESC, term) AS INTEGER) AS rank FROM rows_ WHERE weight IS NOT NULL) WHERE rank <= 5""",
        "p6_found": f"""WITH {_UNITS},
near AS (SELECT a.vector_id AS i, b.vector_id AS j, list_cosine_similarity(a.v, b.v) AS s FROM nodes a JOIN nodes b ON a.ns = b.ns AND a.dims = b.dims AND a.vector_id <> b.vector_id),
best AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY s DESC, j) AS rn FROM near)
SELECT DISTINCT least(i, j) AS vector_id_a, greatest(i, j) AS vector_id_b FROM best WHERE rn <= 10 AND s >= 0.9""",
        "p8_found": f"WITH d AS ({_grams_sql('documents', 'doc_id')}), e AS ({_grams_sql('eval_items', 'item_id')}) SELECT DISTINCT doc_id, item_id FROM d JOIN e USING (gram)",
        "p9_mix_held": """WITH wanted AS (SELECT replace(lower(trim(source_name)), '_', '-') AS source_name, sum(coalesce(target_share, 0)) AS share, max(coalesce(max_repeats, 1)) AS most FROM mix_targets WHERE source_name IS NOT NULL GROUP BY 1),
held AS (SELECT DISTINCT replace(lower(trim(source)), '_', '-') AS source_name FROM documents WHERE source IS NOT NULL AND doc_id IS NOT NULL AND text <> '')
SELECT source_name, share > 0 AND most > 0 AND source_name IN (SELECT source_name FROM held) AS reachable, true AS capped, true AS near FROM wanted""",
        "p10_found": f"WITH {_MEASURED} SELECT doc_id FROM graded WHERE words >= 40 AND grade >= 16",
        "p10_measures": f"WITH {_MEASURED} SELECT doc_id, letters, words, sentences, round(grade, 6) + 0.0 AS grade FROM graded",
        "p7_found": f"""WITH {_CURRENT}
SELECT ns, term FROM spread LEFT JOIN sizes USING (ns) WHERE gf < 3 OR df * 100 > total_docs * 30""",
        "p7_frequencies": f"""WITH {_CURRENT}
SELECT ns, CAST(1 AS INTEGER) AS n, term, gf AS total_tf, df, total_docs,
       CASE WHEN gf < 3 THEN 'too_rare' WHEN df * 100 > total_docs * 30 THEN 'too_common' END AS mark
FROM spread LEFT JOIN sizes USING (ns)""",
        "p7_repeated": f"""WITH {_CURRENT},
places AS (SELECT ns, doc_id, lower(trim(term)) AS t1, unnest(positions) AS pos FROM once),
seq AS (SELECT ns, doc_id, list(t1 ORDER BY pos, t1) AS w FROM places GROUP BY ns, doc_id),
starts AS (SELECT ns, doc_id, w, unnest(generate_series(1, len(w))) AS i FROM seq),
spans AS (SELECT ns, doc_id, w, i, unnest(generate_series(i, len(w))) AS j FROM starts),
grams AS (SELECT ns, doc_id, j - i + 1 AS n, array_to_string(w[i:j], chr(31)) AS gram, array_to_string(w[i:j - 1], chr(31)) AS head FROM spans),
counted AS (SELECT ns, n, gram, any_value(head) AS head, count(*) AS total_tf, count(DISTINCT doc_id) AS df FROM grams GROUP BY ns, n, gram HAVING count(*) > 1),
longer AS (SELECT ns, n - 1 AS n, head AS gram, max(total_tf) AS most FROM counted GROUP BY 1, 2, 3)
SELECT ns, CAST(n AS INTEGER) AS n, gram, total_tf, df FROM counted LEFT JOIN longer USING (ns, n, gram) WHERE most IS NULL OR most < total_tf""",
        "p7_ngrams": f"""WITH {_CURRENT},
places AS (SELECT ns, doc_id, lower(trim(term)) AS t1, unnest(positions) AS pos FROM once),
seq AS (SELECT ns, doc_id, t1, lead(t1, 1) OVER w AS t2, lead(t1, 2) OVER w AS t3 FROM places WINDOW w AS (PARTITION BY ns, doc_id ORDER BY pos, t1)),
grams AS (SELECT ns, doc_id, 1 AS n, t1 AS term FROM seq
          UNION ALL SELECT ns, doc_id, 2, t1 || ' ' || t2 FROM seq WHERE t2 IS NOT NULL
          UNION ALL SELECT ns, doc_id, 3, t1 || ' ' || t2 || ' ' || t3 FROM seq WHERE t3 IS NOT NULL)
SELECT ns, CAST(n AS INTEGER) AS n, term, count(*) AS total_tf, count(DISTINCT doc_id) AS df FROM grams GROUP BY ns, n, term""",
    }
