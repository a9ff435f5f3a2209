"""DuckDB SQL for the queries of the catalog, over the same tables."""

from __future__ import annotations

from lexigrade.functions import lexicons as L
from lexigrade.functions import licenses
from lexigrade.functions.text import SILENT, SYLLABIC_ENDING, VOWELS
from lexigrade.sources.files import EXCLUDED_FOLDERS, LANGUAGE_BY_EXTENSION


def _list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def _quote(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


WORD = r"[\p{L}\p{N}]+(?:[''’-][\p{L}\p{N}]+)*"


def _syllables(w: str) -> str:
    return f"(len(regexp_extract_all(lower({w}), '[{VOWELS}]+')) - CAST(regexp_matches(lower({w}), {_quote(SILENT)}) AS INT) + CAST(lower({w}) IN {_list(L.SYLLABLE_EXTRA)} AS INT))"


def _sentences(text: str) -> str:
    marked = rf"regexp_replace({text}, '(?i)\b(e\.g|i\.e|etc|vs|cf)\.(\s)', '\1.' || chr(1) || '\2', 'g')"
    cut = rf"regexp_replace({marked}, '([.!?][\"''”’)\]]*)\s+', '\1' || chr(2), 'g')".replace('\\"', '"')
    return f"replace({cut}, chr(1), '')"


def _stats(source: str = "documents", keys: str = "doc_id, lang") -> str:
    first = keys.split(",")[0]
    return rf"""
base AS (SELECT row_number() OVER () AS rid, {keys}, coalesce(text, '') AS text FROM {source}
), found AS (
  SELECT rid, unnest(list_filter(regexp_extract_all(text, '{WORD}'), lambda w: regexp_matches(w, '\p{{L}}'))) AS w FROM base
), counted AS (
  SELECT rid, w, greatest(1, {_syllables("w")}) AS n FROM found
), folded AS (
  SELECT rid, count(*) AS words, sum(n) AS syllables, count(*) FILTER (WHERE
    NOT (contains(w, '-') AND len(list_filter(string_split(w, '-'), lambda p: {_syllables("p")} > 1)) = 0)
    AND n - CAST(regexp_matches(lower(w), {_quote(SYLLABIC_ENDING)}) AS INT) >= 3) AS complex_words
  FROM counted GROUP BY rid
), sentence AS (
  SELECT rid, line_no, s.place AS place, s.sentence AS sentence FROM (
    SELECT rid, line_no, unnest(list_transform(string_split({_sentences("line")}, chr(2)), lambda x, i: {{'place': i, 'sentence': x}})) AS s
    FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line_no FROM base))
  WHERE regexp_matches(s.sentence, '\p{{L}}')
), stats AS (
  SELECT {keys}, rid, CAST(coalesce(n_sentences, 0) AS BIGINT) AS sentences, CAST(coalesce(words, 0) AS BIGINT) AS words, CAST(coalesce(syllables, 0) AS BIGINT) AS syllables,
    CAST(length(regexp_replace(text, '\P{{L}}', '', 'g')) AS BIGINT) AS letters, CAST(coalesce(complex_words, 0) AS BIGINT) AS complex_words
  FROM base LEFT JOIN folded USING (rid) LEFT JOIN (SELECT rid, count(*) AS n_sentences FROM sentence GROUP BY rid) USING (rid)
)""".replace("{first}", first)


_ROUND = "floor(({x}) * 100.0 + 0.5) / 100.0"
_METRICS = """
metric AS (
  SELECT *, CASE WHEN words = 0 THEN 0.0 ELSE floor((CAST(0.39 AS DOUBLE) * (words / sentences) + CAST(11.8 AS DOUBLE) * (syllables / words) - CAST(15.59 AS DOUBLE)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS fleschKincaidGrade,
    CASE WHEN words = 0 THEN 0.0 ELSE floor((CAST(0.4 AS DOUBLE) * (words / sentences + 100 * (complex_words / words))) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS gunningFog,
    CASE WHEN words = 0 THEN 0.0 ELSE floor((CAST(0.0588 AS DOUBLE) * (letters / words * 100) - CAST(0.296 AS DOUBLE) * (sentences / words * 100) - CAST(15.8 AS DOUBLE)) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS colemanLiau,
    CASE WHEN words = 0 THEN 0.0 ELSE floor((words / sentences) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS averageSentenceLength
  FROM stats
)"""
_RAMPED = [w for w in L.WEIGHTS if w[5]]
_NUMBER = "CASE WHEN {v} = floor({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"


def _composite(keys: str) -> str:
    """CTEs from metric to composed(keys, words, raw, score, label, blend, reasons, briefs)."""
    texts = {"fleschKincaidGrade": ("Flesch-Kincaid grade ", "", 12, "grade ", ""), "gunningFog": ("Gunning Fog index ", "", 12, "fog ", ""), "colemanLiau": ("Coleman-Liau index ", "", 12, "Coleman-Liau ", ""), "averageSentenceLength": ("Long sentences: ", " words on average", 25, "", " words/sentence")}
    hard = ", ".join(f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, ({m} - {e}::DOUBLE) / {h - e}::DOUBLE)) AS d{k}, {w}::DOUBLE * blend AS w{k}" for k, (m, w, _, e, h, _r) in enumerate(_RAMPED))
    points = ", ".join(f"CASE WHEN total = 0 THEN 0.0::DOUBLE ELSE 10 * w{k} * d{k} / total END AS p{k}" for k in range(4))
    items = ", ".join(
        f"{{'p': p{k}, 'k': {k}, 'reason': CASE WHEN {m} >= {texts[m][2]} THEN '{texts[m][0]}' || {_NUMBER.format(v=m)} || '{texts[m][1]}' END, 'brief': '{texts[m][3]}' || {_NUMBER.format(v=m)} || '{texts[m][4]}'}}"
        for k, (m, *_rest) in enumerate(_RAMPED)
    )
    return f"""
ramped AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, (words - 20) / 20.0::DOUBLE)) AS blend FROM metric WHERE words >= 3
), hard AS (SELECT *, {hard} FROM ramped
), summed AS (SELECT *, 0.0::DOUBLE + w0 + w1 + w2 + w3 AS total FROM hard
), pointed AS (SELECT *, {points} FROM summed
), listed AS (SELECT *, 0.0::DOUBLE + p0 + p1 + p2 + p3 AS raw, list_filter([{items}], lambda c: c.p > 0) AS cs FROM pointed
), ranked AS (
  SELECT rid, string_agg(c.reason, '; ' ORDER BY c.p DESC, c.k) FILTER (WHERE reason_place <= 3) AS reasons,
    string_agg(c.brief, ' · ' ORDER BY c.reason IS NULL, c.p DESC, c.k) FILTER (WHERE lens_place <= 2) AS briefs
  FROM (
    SELECT rid, c, CASE WHEN c.reason IS NOT NULL THEN count(c.reason) OVER (PARTITION BY rid ORDER BY c.p DESC, c.k ROWS UNBOUNDED PRECEDING) END AS reason_place,
      row_number() OVER (PARTITION BY rid ORDER BY c.reason IS NULL, c.p DESC, c.k) AS lens_place
    FROM (SELECT rid, unnest(cs) AS c FROM listed)) GROUP BY rid
), composed AS (
  SELECT {keys}, words, raw, floor(raw * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS score, CASE WHEN raw >= {L.BAND_HARD}::DOUBLE THEN 'hard' WHEN raw >= {L.BAND_OK}::DOUBLE THEN 'ok' ELSE 'easy' END AS label,
    blend AS readability, coalesce(reasons, '') AS reasons, coalesce(briefs, '') AS briefs
  FROM listed LEFT JOIN ranked USING (rid)
)"""


_DOCS = f"WITH {_stats()}"
_SCORES = f"{_DOCS}, {_METRICS}, {_composite('doc_id, lang')}"
_JUDGED = f"{_SCORES}, judged AS (SELECT c.*, CASE WHEN quality = 1 THEN 'easy' ELSE 'hard' END AS human FROM composed c JOIN labels l USING (doc_id))"

_POS = " ".join(
    ["CASE WHEN NOT regexp_matches(t, '[\\p{L}\\p{N}]') THEN 'PUNCT' WHEN regexp_matches(t, '^[0-9][0-9.,]*$') THEN 'NUM' WHEN regexp_matches(t, '^[A-Z]{2,}s?$') THEN 'PROPN'"]
    + [f"WHEN lower(t) IN {_list(ws)} THEN '{pos}'" for pos, ws in L.POS_WORDS.items()]
    + [f"WHEN regexp_matches(lower(t), '{suffix}') THEN '{pos}'" for pos, suffix in L.POS_SUFFIXES]
    + ["ELSE 'NOUN' END"]
)
_TOKENS = rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(regexp_replace(coalesce(text, ''), '(?i)([a-z])(n''t|''s|''re|''ve|''ll|''d|''m)([^a-z]|$)', '\1 \2\3', 'g'), '(?i)n''t|''(?:re|ve|ll|s|d|m)|[\p{{L}}\p{{N}}]+(?:[-_.''’][\p{{L}}\p{{N}}]+)*|[^\s\p{{L}}\p{{N}}]') AS ts
  FROM documents
), tok AS (
  SELECT doc_id, i, t, lower(t) AS normal, {_POS} AS pos FROM (SELECT doc_id, unnest(ts) AS t, unnest(generate_series(1, len(ts))) AS i FROM split)
)"""


def _metric_sql(value: str, body: str = "", reason: str = "NULL") -> str:
    """doc_id, value, reason_md5 of ``m(doc_id, v, ...)`` that body defines."""
    return f"{_TOKENS}{body} SELECT doc_id, CAST({value} AS DOUBLE) AS value, md5(coalesce({reason}, '')) AS reason_md5 FROM split LEFT JOIN m USING (doc_id)"


_WORD_TOKEN = f"pos IN {_list(L.WORD_TAGS)}"
_PLAIN = "regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')"
_ZIPF = f"""occ AS (SELECT doc_id, unnest({_PLAIN}) AS word FROM documents
), zipf AS (
  SELECT word, floor(log10(n * 1e9::DOUBLE / total) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS zipf
  FROM (SELECT word, count(*) AS n FROM occ GROUP BY word), (SELECT count(*) AS total FROM occ) ORDER BY n DESC, word LIMIT 50000
)"""
_VOCAB = "pairs AS (SELECT DISTINCT doc_id, word FROM occ), vocab AS (SELECT word, count(*) AS files FROM pairs GROUP BY word ORDER BY files DESC, word LIMIT {k})"

_CANON = "CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.CANONICAL.items()) + " END"
_DOUBLES = "CASE WHEN length({b}) >= 2 AND right({b}, 1) = substr({b}, length({b}) - 1, 1) AND NOT regexp_matches(right({b}, 1), '[aeiou]') THEN left({b}, length({b}) - 1) ELSE {b} END"


def _stem_ctes(source: str) -> str:
    """source(k, place, w) to stems(k, place, s)."""
    return f"""
s1 AS (SELECT *, coalesce({_CANON.format(x="w")}, w) AS a FROM {source}
), s2 AS (SELECT *, CASE WHEN length(a) > 4 AND ends_with(a, 'ies') THEN left(a, length(a) - 3) || 'y'
    WHEN length(a) > 4 AND regexp_matches(a, '(?:[sxz]|[cs]h)es$') THEN left(a, length(a) - 2)
    WHEN length(a) > 3 AND ends_with(a, 's') AND NOT regexp_matches(a, '(?:ss|us|is)$') THEN left(a, length(a) - 1) ELSE a END AS b FROM s1
), s3 AS (SELECT *, regexp_extract(b, '^(.{{3,}}?)(?:ing|ed)$', 1) AS c FROM s2
), s4 AS (SELECT *, CASE WHEN c <> '' THEN {_DOUBLES.format(b="c")} ELSE b END AS d FROM s3
), stems AS (SELECT k, place, coalesce({_CANON.format(x="d")}, {_CANON.format(x="(d || 'e')")}, d) AS s FROM s4)"""


_LINES = "lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS body, unnest(generate_series(0, len(string_split(coalesce(text, ''), chr(10))) - 1)) AS \"row\" FROM documents)"
_LICENSED = f"""
flag AS (
  SELECT doc_id, "row", body, regexp_matches(body, {_quote(licenses.NOTICE)}) OR regexp_matches(body, {_quote(licenses.BOILERPLATE)}) OR regexp_matches(body, {_quote(licenses.NAME)}) AS said,
    regexp_extract_all(lower(body), '[a-z0-9]+') AS ws FROM lines
), tri AS (
  SELECT doc_id, "row", k, array_to_string(ws[k : k + 2], ' ') IN {_list(licenses.TRIGRAMS)} AS known FROM (SELECT doc_id, "row", ws, unnest(generate_series(1, len(ws) - 2)) AS k FROM flag WHERE len(ws) >= 3)
), isle AS (SELECT doc_id, "row", known, k - row_number() OVER (PARTITION BY doc_id, "row", known ORDER BY k) AS g FROM tri
), run AS (SELECT doc_id, "row", max(n) AS longest FROM (SELECT doc_id, "row", g, count(*) AS n FROM isle WHERE known GROUP BY ALL) GROUP BY ALL
), share AS (SELECT doc_id, "row", avg(CAST(known AS INT)) AS share FROM tri GROUP BY ALL
), licensed AS (
  SELECT flag.doc_id, flag."row", body, said OR CASE WHEN len(ws) < 3 THEN len(ws) > 0 AND len(list_filter(ws, lambda x: x NOT IN {_list(licenses.WORDS)})) = 0
    ELSE share >= 0.6 OR coalesce(longest, 0) >= 4 END AS lic
  FROM flag LEFT JOIN share USING (doc_id, "row") LEFT JOIN run USING (doc_id, "row")
)"""
_STRICT = f"(regexp_matches(text, {_quote(licenses.BOILERPLATE)}) OR (regexp_matches(text, {_quote(licenses.NOTICE)}) AND regexp_matches(text, {_quote(licenses.NAME)})))"
_PATH = "regexp_replace(url, '^[a-z]+://', '')"
_LANGUAGE = "CASE lower(regexp_extract({p}, '\\.([^./\\\\]+)$', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_BY_EXTENSION.items()) + " END"

ORACLE_SQL: dict[str, str] = {
    "sentence_split": f"{_DOCS} SELECT doc_id, row_number() OVER (PARTITION BY rid ORDER BY line_no, place) - 1 AS place, md5(sentence) AS sentence_md5 FROM sentence JOIN base USING (rid)",
    "word_match": rf"SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, md5(array_to_string(ws, ' ')) AS words_md5 FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '{WORD}'), lambda w: regexp_matches(w, '\p{{L}}')) AS ws FROM documents)",
    "text_statistics": f"{_DOCS} SELECT doc_id, sentences, words, syllables, letters, complex_words FROM stats",
    "readability_metrics": f"{_DOCS}, {_METRICS} SELECT doc_id, fleschKincaidGrade, gunningFog, colemanLiau, averageSentenceLength FROM metric",
    "readability_ramp": f"{_DOCS} SELECT greatest(0.0::DOUBLE, least(1.0::DOUBLE, (words - 20) / 20.0::DOUBLE)) AS weight, count(*) AS n FROM stats GROUP BY 1",
    "composite_readability": f"{_SCORES} SELECT doc_id, words, score, label, readability, reasons FROM composed",
    "label_distribution": f"{_SCORES} SELECT label, count(*) AS n, floor(100 * count(*) / sum(count(*)) OVER () * 10.0::DOUBLE + 0.5::DOUBLE) / 10.0::DOUBLE AS percent FROM composed GROUP BY label",
    "language_report": f"{_SCORES} SELECT lang, count(*) AS texts, CAST(sum(words) AS BIGINT) AS words, count(*) FILTER (WHERE label = 'hard') AS hard FROM composed GROUP BY lang",
    "top_complex": f"{_SCORES} SELECT doc_id, score FROM composed ORDER BY score DESC, doc_id LIMIT 10",
    "above_threshold": f"{_SCORES} SELECT doc_id, score FROM composed WHERE score >= 5",
    "lens_title": f"{_SCORES} SELECT doc_id, 'complexity ' || printf('%.1f', score) || CASE WHEN briefs = '' THEN '' ELSE ' · ' || briefs END AS title FROM composed",
    "diagnostic_message": f"{_SCORES} SELECT doc_id, 'Comment complexity ' || printf('%.1f', score) || ' (' || label || ')' || CASE WHEN reasons = '' THEN '' ELSE ': ' || reasons END AS message FROM composed",
    "min_words_filter": rf"SELECT kind, count(*) AS texts, count(*) FILTER (WHERE len(list_filter(regexp_extract_all(coalesce(text, ''), '{WORD}'), lambda w: regexp_matches(w, '\p{{L}}'))) >= 3) AS long_enough FROM (SELECT 'documents' AS kind, text FROM documents UNION ALL SELECT 'conversations', text FROM conversations) GROUP BY kind",
    "metric_nounStack": _metric_sql(
        "coalesce(n, 0)",
        """, isle AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, pos IN ('NOUN', 'ADJ', 'PROPN') ORDER BY i) AS g FROM tok
        ), stacks AS (SELECT doc_id, g, count(*) AS n, min(i) AS first, string_agg(t, ' ' ORDER BY i) AS said FROM isle WHERE pos IN ('NOUN', 'ADJ', 'PROPN') GROUP BY doc_id, g
        ), m AS (SELECT doc_id, n, said FROM stacks QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) = 1)""",
        "CASE WHEN n >= 3 THEN 'Noun stack: \"' || said || '\"' END",
    ),
    "metric_clauseCount": _metric_sql(
        "greatest(coalesce(groups, 0), coalesce(links, 0) + CAST(coalesce(groups, 0) > 0 AS INT))",
        f""", verbs AS (SELECT doc_id, pos IN ('VERB', 'AUX') AS v, lag(pos IN ('VERB', 'AUX')) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM tok WHERE pos NOT IN ('PART', 'ADV')
        ), m AS (SELECT doc_id, groups, links FROM (SELECT doc_id, count(*) FILTER (WHERE v AND NOT coalesce(before, false)) AS groups FROM verbs GROUP BY doc_id)
          FULL JOIN (SELECT doc_id, count(*) FILTER (WHERE normal IN {_list(L.SUBORDINATORS)} AND pos <> 'DET') AS links FROM tok GROUP BY doc_id) USING (doc_id))""",
        "CASE WHEN greatest(coalesce(groups, 0), coalesce(links, 0) + CAST(coalesce(groups, 0) > 0 AS INT)) >= 3 THEN CAST(greatest(coalesce(groups, 0), coalesce(links, 0) + CAST(coalesce(groups, 0) > 0 AS INT)) AS VARCHAR) || ' clauses in one comment' END",
    ),
    "metric_lexicalDensity": _metric_sql(
        "coalesce(v, 0)",
        f", m AS (SELECT doc_id, CASE WHEN count(*) FILTER (WHERE {_WORD_TOKEN}) = 0 THEN 0 ELSE floor(count(*) FILTER (WHERE pos IN {_list(L.CONTENT_TAGS)}) / count(*) FILTER (WHERE {_WORD_TOKEN}) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE END AS v FROM tok GROUP BY doc_id)",
        "CASE WHEN v >= 0.75 THEN 'Dense: ' || CAST(CAST(floor(v * 100 + 0.5) AS BIGINT) AS VARCHAR) || '% content words' END",
    ),
    "metric_negationCount": _metric_sql("coalesce(n, 0)", f", m AS (SELECT doc_id, count(*) FILTER (WHERE normal IN {_list(L.NEGATIONS)}) AS n FROM tok GROUP BY doc_id)", "CASE WHEN n >= 2 THEN CAST(n AS VARCHAR) || ' negations' END"),
    "metric_danglingReference": _metric_sql(
        "coalesce(n, 0)",
        f""", near AS (SELECT *, lead(pos) OVER (PARTITION BY doc_id ORDER BY i) AS following, min(i) FILTER (WHERE pos IN ('NOUN', 'PROPN')) OVER (PARTITION BY doc_id) AS named FROM tok
        ), m AS (SELECT doc_id, count(*) AS n, arg_min(t, i) AS first FROM near WHERE (named IS NULL OR i < named) AND normal IN {_list(L.REFERENCES)}
          AND (pos = 'PRON' OR (pos = 'DET' AND (following IS NULL OR following NOT IN ('NOUN', 'PROPN', 'ADJ', 'NUM')))) GROUP BY doc_id)""",
        "CASE WHEN n > 0 THEN '\"' || first || '\" has no antecedent' END",
    ),
    "metric_commentLength": _metric_sql("coalesce(n, 0)", f", m AS (SELECT doc_id, count(*) FILTER (WHERE {_WORD_TOKEN}) AS n FROM tok GROUP BY doc_id)", "CASE WHEN n >= 60 THEN 'Long comment: ' || CAST(n AS VARCHAR) || ' words' END"),
    "zipf_table": f"WITH {_ZIPF} SELECT word, zipf FROM zipf",
    "zipf_metrics": f"""WITH {_ZIPF}, {_VOCAB.format(k=100)} SELECT doc_id, count(*) AS rated, floor(sum(CAST(round(coalesce(zipf, 2.0::DOUBLE) * 100) AS BIGINT)) / count(*) / 100 * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS mean_zipf,
        least(7.0::DOUBLE, min(coalesce(zipf, 2.0::DOUBLE))) AS min_zipf FROM occ ANTI JOIN vocab USING (word) LEFT JOIN zipf USING (word) GROUP BY doc_id""",
    "vocabulary_topk": f"WITH occ AS (SELECT doc_id, unnest({_PLAIN}) AS word FROM documents), {_VOCAB.format(k=L.MAX_VOCABULARY)} SELECT word, files FROM vocab",
    "vocabulary_by_source": f"SELECT word, count(DISTINCT source) AS files FROM (SELECT source, unnest({_PLAIN}) AS word FROM documents) GROUP BY word HAVING count(DISTINCT source) > 1",
    "vocabulary_files": f"SELECT count(DISTINCT source) AS files FROM (SELECT source, unnest({_PLAIN}) AS word FROM documents)",
    "admitted_changes": f"""WITH tracked AS (SELECT DISTINCT c_custkey AS f FROM customer WHERE c_custkey IS NOT NULL), fresh AS (
          SELECT user_id, row_number() OVER (ORDER BY min(event_id), user_id) AS place FROM events WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT f FROM tracked) GROUP BY user_id
        ) SELECT event_id, user_id FROM events WHERE user_id IN (SELECT f FROM tracked)
          OR user_id IN (SELECT user_id FROM fresh WHERE place + (SELECT count(*) FROM tracked) <= {L.MAX_FILES})""",
    "evicted_results": "SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS length FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
    "content_word_stems": rf"""WITH ws AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}]{{2,}}'), lambda w: w NOT IN {_list(L.FILLER)}) AS ws FROM documents
        ), one AS (SELECT doc_id AS k, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS place FROM ws), {_stem_ctes("one")}
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, md5(coalesce(said, '')) AS stems_md5 FROM ws LEFT JOIN (SELECT k AS doc_id, string_agg(s, ' ' ORDER BY place) AS said FROM stems GROUP BY k) USING (doc_id)""",
    "redundancy_of_names": rf"""WITH names AS (SELECT p_partkey, string_split(trim(regexp_replace(regexp_replace(regexp_replace(replace(p_name, ' ', '_'), '[.:_$]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g')), ' ') AS parts FROM part
        ), ws AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_type), '[\p{{L}}\p{{N}}]{{2,}}'), lambda w: w NOT IN {_list(L.FILLER)}) AS ws FROM part
        ), one AS (SELECT 'w' || p_partkey AS k, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS place FROM ws UNION ALL SELECT 'p' || p_partkey, unnest(list_transform(parts, lambda x: lower(x))), unnest(generate_series(1, len(parts))) FROM names), {_stem_ctes("one")}
        , said AS (SELECT a.k, a.place, max(CAST(a.s = b.s OR (least(length(a.s), length(b.s)) >= 4 AND abs(length(a.s) - length(b.s)) <= 2 AND (starts_with(a.s, b.s) OR starts_with(b.s, a.s))) AS INT)) AS hit
          FROM stems a JOIN stems b ON a.k[1] = 'w' AND b.k[1] = 'p' AND a.k[2:] = b.k[2:] GROUP BY ALL
        ), share AS (SELECT CAST(k[2:] AS BIGINT) AS p_partkey, sum(hit) / count(*) AS share FROM said GROUP BY k)
        SELECT p_partkey, coalesce(share, 0) >= 0.75 AS redundant, floor(coalesce(share, 0) * 100.0::DOUBLE + 0.5::DOUBLE) / 100.0::DOUBLE AS overlap FROM part LEFT JOIN share USING (p_partkey)""",
    "split_identifiers": rf"SELECT page_id, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({_PATH}, '[^A-Za-z0-9_.]', '_', 'g'), '[.:_$]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'))) AS words FROM pages",
    "license_lines": f'WITH {_LINES}, {_LICENSED} SELECT doc_id, count(*) AS n_lines, CAST(min("row") AS BIGINT) AS first_row FROM licensed WHERE lic GROUP BY doc_id',
    "license_texts": f"SELECT * FROM (SELECT doc_id, {_STRICT} AS strict, regexp_matches(text, {_quote(licenses.LICENSE)}) AS weak FROM documents WHERE text IS NOT NULL) WHERE strict OR weak",
    "structured_blocks": f"""WITH ls AS (SELECT event_id, list_filter(list_transform(string_split(replace(replace(props, ',', ',' || chr(10)), '{{', '{{' || chr(10)), chr(10)), lambda s: rtrim(regexp_replace(s, '^[\\s*]*', ''))), lambda s: s <> '') AS ls FROM events
        ) SELECT coalesce(regexp_matches(ls[1], {_quote(licenses.MARKER)}), false) OR (len(ls) >= 3 AND len(list_filter(ls, lambda s: regexp_matches(s, {_quote(licenses.DATA_LINE)}))) / len(ls) >= 0.6) AS structured, count(*) AS n FROM ls GROUP BY 1""",
    "line_run_lengths": f"""WITH {_LINES}, {_LICENSED}, marked AS (SELECT *, lag("row") OVER w AS r, lag(lic) OVER w AS l FROM licensed WHERE body <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY "row")
        ), numbered AS (SELECT *, sum(CAST(NOT coalesce(r = "row" - 1 AND l = lic, false) AS INT)) OVER (PARTITION BY doc_id ORDER BY "row") AS run FROM marked)
        SELECT doc_id AS path, CAST(run AS BIGINT) AS run, CAST(min("row") AS BIGINT) AS first_row, count(*) AS n FROM numbered GROUP BY ALL""",
    "page_comments": r"""SELECT page_id, CAST(place - 1 AS BIGINT) AS place, body FROM (SELECT page_id, unnest(generate_series(1, len(cs))) AS place, unnest(list_transform(cs, lambda c: trim(regexp_replace(regexp_replace(c, '^<!--', ''), '-->$', '')))) AS body
        FROM (SELECT page_id, regexp_extract_all(html, '(?s)<!--.*?(?:-->|\z)') AS cs FROM pages)) WHERE body <> ''""",
    "path_filters": f"""SELECT page_id, (p = 'example.com' OR starts_with(p, 'example.com/')) AS within, coalesce({_LANGUAGE.format(p="p")}, '') AS language,
        ({_LANGUAGE.format(p="p")}) IS NOT NULL AND NOT list_has_any(string_split(p, '/')[:-2], [{", ".join(repr(e) for e in EXCLUDED_FOLDERS)}]) AS scanned, regexp_extract(p, '^([^/]*)', 1) AS host FROM (SELECT page_id, {_PATH} AS p FROM pages)""",
    "confusion": f"{_JUDGED} SELECT human, count(*) FILTER (WHERE label = 'easy') AS easy, count(*) FILTER (WHERE label = 'ok') AS ok, count(*) FILTER (WHERE label = 'hard') AS hard FROM judged GROUP BY human",
    "agreement": f"{_JUDGED} SELECT coalesce(avg(CAST(human = label AS INT)), 0) AS agreement FROM judged",
    "pair_order": f"""{_JUDGED}, r AS (SELECT human, floor(raw * 1000000.0::DOUBLE + 0.5::DOUBLE) / 1000000.0::DOUBLE AS raw FROM judged), names(lower, higher) AS (VALUES ('easy', 'ok'), ('ok', 'hard'), ('easy', 'hard'))
        SELECT lower, higher, CAST(coalesce(sum(CASE WHEN a.raw < b.raw THEN 1.0 WHEN a.raw = b.raw THEN 0.5 WHEN b.raw IS NULL THEN 0 ELSE 0.0 END), 0) AS DOUBLE) AS ordered, count(b.raw) AS pairs
        FROM names LEFT JOIN r a ON a.human = lower LEFT JOIN r b ON b.human = higher AND a.raw IS NOT NULL GROUP BY lower, higher""",
    "fold_split": "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) % 5 AS INT) AS fold FROM labels",
    "dedupe_score_join": f"{_DOCS} SELECT doc_id, words, sentences FROM stats",
    "latest_version": "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "debounce": "SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS following FROM events) WHERE following IS NULL OR epoch_ms(following) - epoch_ms(ts) > 3600000",
    "conversation_turn_scores": f"WITH {_stats('conversations', 'role')}, {_METRICS}, {_composite('role')} SELECT role, count(*) AS n, CAST(sum(CAST(round(score * 10) AS BIGINT)) AS BIGINT) AS tenths FROM composed GROUP BY role",
    "sentence_rank": f"{_DOCS} SELECT doc_id, lang, sentences, CAST(row_number() OVER (PARTITION BY lang ORDER BY sentences DESC, doc_id) AS INT) AS place FROM stats QUALIFY place <= 3",
}
