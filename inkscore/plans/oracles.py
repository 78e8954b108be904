"""The same queries as SQL over the same tables, written independently of the Spark plans."""

from __future__ import annotations

from ..functions import fixed_values as fv
from . import bindings as b
from .catalogue import SAMPLE_LEXICON


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def names(values) -> str:
    return ", ".join(literal(v) for v in values)


TOKEN = literal(fv.TOKEN_PATTERN)
WORD = literal(fv.WORD_PATTERN)
SPACED = literal(fv.SPACED_WORD_PATTERN)
TERM = literal(fv.TERM_PATTERN)
ENDING = literal(fv.SENTENCE_END_PATTERN)
QUOTE = literal(fv.QUOTE_PATTERN)
STOP = names(fv.STOP_WORDS)

TEXTS = """
prompts AS (
  SELECT CAST(item_id AS VARCHAR) AS prompt_id,
         array_to_string(string_split(text, ' ')[1:6], ' ') AS prompt_question,
         array_to_string(string_split(text, ' ')[1:3], ' ') AS prompt_title,
         text AS prompt_text
  FROM benchmark),
summaries AS (
  SELECT CAST(doc_id AS VARCHAR) AS student_id,
         CAST(doc_id % (SELECT count(*) FROM benchmark) AS VARCHAR) AS prompt_id, text
  FROM documents),
truth AS (
  SELECT CAST(doc_id AS VARCHAR) AS student_id, CAST(quality AS DOUBLE) AS content, CAST(toxic AS DOUBLE) AS wording
  FROM labels)"""

PAIRS = f"""{TEXTS},
pairs AS (
  SELECT s.student_id, s.prompt_id, s.text, p.prompt_text, p.prompt_title, p.prompt_question,
         regexp_extract_all(s.text, {TOKEN}) AS st, regexp_extract_all(p.prompt_text, {TOKEN}) AS pt,
         regexp_extract_all(s.text, {SPACED}) AS sw, regexp_extract_all(p.prompt_text, {SPACED}) AS pw
  FROM summaries s LEFT JOIN prompts p USING (prompt_id))"""

PREDS = f"""
models AS (
  SELECT m, 'model_' || lpad(CAST(m AS VARCHAR), 2, '0') || CASE WHEN m % 4 = 0 THEN '_clean_text' ELSE '' END AS model
  FROM range(1, {b.N_MODELS + 1}) r(m)),
scored AS (
  SELECT vec_id AS row_id, CAST(vec_id % 4 AS INTEGER) AS fold, m, model, target,
         CAST(embedding[m + CASE WHEN target = 'wording' THEN {b.N_MODELS} ELSE 0 END] AS DOUBLE) AS pred,
         CASE WHEN target = 'content' THEN CAST(label AS DOUBLE) ELSE CAST(embedding[64] AS DOUBLE) END AS y
  FROM embeddings, models, (VALUES ('content'), ('wording')) t(target))"""

FORMULA_WEIGHTS = f"""
weights AS (SELECT model, ((m * 7) % 31 - 10) / 20.0 AS weight FROM models)"""


def readability_counts(text: str) -> str:
    """Counts by visiting each word."""
    return f"""
    SELECT *, CASE WHEN len(regexp_extract_all(txt, {SPACED})) = 0 THEN 0
                   ELSE greatest(1, len(regexp_extract_all(txt, {ENDING}))) END AS s,
           len(words) AS w,
           coalesce(list_sum([greatest(1, len(regexp_extract_all(x, '[aeiouyAEIOUY]+'))) FOR x IN words]), 0) AS y,
           len([x FOR x IN words IF len(regexp_extract_all(x, '[aeiouyAEIOUY]+')) >= 3]) AS c
    FROM (SELECT *, {text} AS txt, regexp_extract_all({text}, {WORD}) AS words FROM src)"""


BOTH_SIDES = f"""{TEXTS},
src AS (SELECT 'answer' AS side, student_id AS id, text AS txt0 FROM summaries
        UNION ALL SELECT 'passage', prompt_id, prompt_text FROM prompts),
counted AS ({readability_counts('txt0')})"""


def formula(expression: str, name: str) -> str:
    return f"""WITH {BOTH_SIDES}
SELECT side, id, round(CASE WHEN s = 0 OR w = 0 THEN 0.0 ELSE {expression} END, 6) AS {name} FROM counted"""


EASE = "206.835 - 1.015 * (w / s) - 84.6 * (y / w)"
GRADE = "0.39 * (w / s) + 11.8 * (y / w) - 15.59"
FOG = "0.4 * ((w / s) + 100.0 * (c / w))"


def tag_case(token: str) -> str:
    lowered = f"lower({token})"
    parts = []
    for kind, values, tag in fv.TAG_RULES:
        if kind == "word":
            test = f"{lowered} IN ({names(values)})"
        elif kind == "suffix":
            test = "(" + " OR ".join(f"suffix({lowered}, {literal(v)})" for v in values) + ")"
        elif kind == "capital":
            test = f"substr({token}, 1, 1) <> substr({lowered}, 1, 1)"
        elif kind == "number":
            test = f"regexp_full_match({token}, '\\p{{N}}+')"
        else:
            test = f"regexp_full_match({token}, '[^{fv.WORD_CHARS}]')"
        parts.append(f"WHEN {test} THEN {literal(tag)}")
    return f"CASE {' '.join(parts)} ELSE {literal(fv.DEFAULT_TAG)} END"


def per_answer(*columns: str) -> str:
    return f"WITH {TEXTS} SELECT student_id, {', '.join(columns)} FROM summaries"


GREEDY = """
WITH RECURSIVE {ctes}
grp_sizes AS ({source}),
g AS (SELECT key, grp, n, row_number() OVER (PARTITION BY key ORDER BY n DESC, md5(grp), grp) AS rn FROM grp_sizes),
r AS (
  SELECT key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS grp, [CAST(0 AS BIGINT), 0, 0, 0] AS w, CAST(-1 AS INTEGER) AS fold
  FROM (SELECT DISTINCT key FROM grp_sizes)
  UNION ALL
  SELECT g.key, g.rn, g.grp,
         [CASE WHEN i = list_position(r.w, list_min(r.w)) THEN r.w[i] + g.n ELSE r.w[i] END FOR i IN range(1, 5)],
         CAST(list_position(r.w, list_min(r.w)) - 1 AS INTEGER)
  FROM r JOIN g ON g.key = r.key AND g.rn = r.rn + 1)"""


def greedy(source: str, ctes: str = "") -> str:
    return GREEDY.format(ctes=ctes + "," if ctes else "", source=source)


LEXICON = r"""
lexicon AS (
  SELECT word,
         ((length(word) * 7 + ord(word)) % 17) / 8.0 - 1.0 AS polarity,
         ((length(word) + ord(word)) % 9) / 8.0 AS subjectivity,
         ((length(word) * 5 + ord(word)) % 9) - 4.0 AS valence
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM benchmark)),
found AS (
  SELECT student_id, word, polarity, subjectivity, valence
  FROM (SELECT student_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+')) AS word FROM summaries)
  LEFT JOIN lexicon USING (word))"""


def valence_columns(suffix: str = "") -> str:
    return f"""
  round(coalesce(n / nullif(p + n + z, 0), 0.0), 6) AS neg{suffix},
  round(coalesce(z / nullif(p + n + z, 0), 0.0), 6) AS neu{suffix},
  round(coalesce(p / nullif(p + n + z, 0), 0.0), 6) AS pos{suffix},
  round(x / sqrt(x * x + 15.0), 6) AS compound{suffix}"""


def valence_sums(value: str = "valence", word: str = "word") -> str:
    return f"""
  coalesce(sum(CASE WHEN {value} > 0 THEN {value} + 1.0 END), 0.0) AS p,
  coalesce(sum(CASE WHEN {value} < 0 THEN 1.0 - {value} END), 0.0) AS n,
  CAST(count(CASE WHEN {word} IS NOT NULL AND coalesce({value}, 0) = 0 THEN 1 END) AS DOUBLE) AS z,
  coalesce(sum({value}), 0.0) AS x"""


SAMPLE = "sample AS (SELECT * FROM (VALUES {}) v(word, polarity, subjectivity, valence))".format(
    ", ".join(f"({literal(w)}, CAST({p} AS DOUBLE), CAST({s} AS DOUBLE), CAST({v} AS DOUBLE))" for w, (p, s, v) in SAMPLE_LEXICON.entries.items())
)

VOCABULARY = f"""
vocab AS (
  SELECT word, coalesce(max(fixed), max(freq)) AS freq FROM (
    SELECT word, count(*) AS freq, NULL::BIGINT AS fixed FROM (SELECT unnest(regexp_extract_all(lower(text), {WORD})) AS word FROM documents)
    GROUP BY word HAVING count(*) >= 5
    UNION ALL
    SELECT DISTINCT unnest(regexp_extract_all(lower(text), {TOKEN})), NULL, CAST({fv.PASSAGE_WORD_FREQUENCY} AS BIGINT) FROM benchmark)
  GROUP BY word)"""

OOV = f"""{VOCABULARY},
oov AS (
  SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), {WORD})) AS word FROM documents)
  WHERE regexp_full_match(word, '[a-zA-Z]+') AND word NOT IN (SELECT word FROM vocab))"""


def deletions(distance: int, source: str, alias: str) -> str:
    """(word, key) with every string reachable by at most ``distance`` deletions."""
    one = "[substr({w}, 1, i - 1) || substr({w}, i + 1) FOR i IN range(1, length({w}) + 1)]"
    steps = [f"{alias}0 AS (SELECT DISTINCT word, word AS key FROM {source})"]
    for k in range(distance):
        steps.append(
            f"{alias}{k + 1} AS (SELECT word, key FROM {alias}{k} UNION"
            f" SELECT word, unnest({one.format(w='key')}) FROM {alias}{k} WHERE key <> '')"
        )
    return ",\n".join(steps)


def candidate_table(distance: int, name: str, unknown: str) -> str:
    return f"""
{deletions(distance, unknown, name + '_u')},
{deletions(distance, name + '_words', name + '_v')},
{name} AS (
  SELECT DISTINCT u.word, v.word AS candidate, d.freq
  FROM {name}_u{distance} u JOIN {name}_v{distance} v USING (key) JOIN vocab d ON d.word = v.word
  WHERE damerau_levenshtein(u.word, v.word) <= {distance})"""


def best(name: str, source: str) -> str:
    return f"""
{name} AS (
  SELECT word, candidate AS correction FROM (
    SELECT *, row_number() OVER (PARTITION BY word ORDER BY freq DESC, candidate DESC) AS rn FROM {source}) WHERE rn = 1)"""


LETTERED = "AS (SELECT word FROM vocab WHERE regexp_full_match(word, '[a-zA-Z]+'))"
NEAR1 = f"""{OOV}, near1_words {LETTERED}, {candidate_table(1, 'near1', 'oov')}"""
CORRECTIONS = f"""{NEAR1}, {best('fix1', 'near1')},
rest AS (SELECT word FROM oov WHERE word NOT IN (SELECT word FROM fix1)),
near2_words {LETTERED}, {candidate_table(2, 'near2', 'rest')}, {best('fix2', 'near2')},
corrections AS (SELECT * FROM fix1 UNION ALL SELECT * FROM fix2)"""

TFIDF = f"""
term_counts AS (
  SELECT student_id, term, CAST(sum(a) AS DOUBLE) AS ca, CAST(sum(c) AS DOUBLE) AS cb FROM (
    SELECT student_id, unnest(regexp_extract_all(lower(text), {TERM})) AS term, 1 AS a, 0 AS c FROM pairs
    UNION ALL
    SELECT student_id, unnest(regexp_extract_all(lower(prompt_text), {TERM})), 0, 1 FROM pairs)
  GROUP BY student_id, term),
weighted AS (
  SELECT student_id, ca * idf AS wa, cb * idf AS wb
  FROM (SELECT *, CASE WHEN ca > 0 AND cb > 0 THEN 1.0 ELSE 1.0 + ln(1.5) END AS idf FROM term_counts)),
cosines AS (
  SELECT student_id, sum(wa * wb) / nullif(sqrt(sum(wa * wa) * sum(wb * wb)), 0) AS cosine FROM weighted GROUP BY student_id)"""


def overlap(n: int) -> str:
    gram = " || ' ' || ".join(["{t}[i]"] + [f"{{t}}[i + {k}]" for k in range(1, n)])
    grams = "[" + gram + f" FOR i IN range(1, len({{t}}) - {n - 2})]"
    return f"len(list_intersect({grams.format(t='st')}, {grams.format(t='pt')}))"


BASIC_COLUMNS = f"""
  len(st) AS summary_length, len(pt) AS prompt_length,
  len(list_distinct([w FOR w IN list_intersect(st, pt) IF w IN ({STOP})])) AS word_overlap_count,
  {overlap(2)} AS bigram_overlap_count,
  round({overlap(2)} / CAST(nullif(len(st) - 1, 0) AS DOUBLE), 6) AS bigram_overlap_ratio,
  {overlap(3)} AS trigram_overlap_count,
  round({overlap(3)} / CAST(nullif(len(st) - 2, 0) AS DOUBLE), 6) AS trigram_overlap_ratio,
  len([q FOR q IN regexp_extract_all(text, {QUOTE}, 1) IF contains(prompt_text, q)]) AS quotes_count"""

JACCARD = "len(list_intersect(st, pt)) / CAST(nullif(len(list_distinct(list_concat(st, pt))), 0) AS DOUBLE)"
DENSITY = "len([w FOR w IN sw IF list_contains(pw, w)]) / CAST(nullif(len(sw), 0) AS DOUBLE)"
AVERAGE_LENGTH = "list_sum([length(w) FOR w IN {w}]) / CAST(nullif(len({w}), 0) AS DOUBLE)"
PUNCTUATION = r"""coalesce(len(regexp_extract_all(text, '[.,!?;:"()\[\]{}]')) / CAST(nullif(length(text), 0) AS DOUBLE), 0.0)"""


def char_count(char: str) -> str:
    return f"length(text) - length(replace(text, {literal(char)}, ''))"


ENRICHED = f"""WITH {PAIRS},
{SAMPLE},
{TFIDF},
src AS (SELECT student_id AS id, text AS txt0 FROM summaries UNION ALL SELECT 'p' || prompt_id, prompt_text FROM prompts),
counted AS ({readability_counts('txt0')}),
ease AS (
  SELECT id, c, CASE WHEN s = 0 OR w = 0 THEN 0.0 ELSE {EASE} END AS e, CASE WHEN s = 0 OR w = 0 THEN 0.0 ELSE {GRADE} END AS k,
         CASE WHEN s = 0 OR w = 0 THEN 0.0 ELSE {FOG} END AS f FROM counted),
hits AS (
  SELECT id, word, polarity, subjectivity, valence
  FROM (SELECT id, unnest(regexp_extract_all(lower(txt0), {WORD})) AS word FROM src) LEFT JOIN sample USING (word)),
sums AS (SELECT id, coalesce(avg(polarity), 0.0) AS pol, coalesce(avg(subjectivity), 0.0) AS sub, {valence_sums()} FROM hits GROUP BY id)
SELECT pairs.student_id, {BASIC_COLUMNS},
  round(ep.f, 6) AS gunning_fog_prompt, round(ep.k, 6) AS flesch_kincaid_grade_level_prompt, round(ep.e, 6) AS flesch_reading_ease_prompt,
  round(ea.e, 6) AS flesch_reading_ease, len(sw) AS word_count, len(string_split(text, '.')) AS sentence_length,
  len(list_distinct(sw)) AS vocabulary_richness, len(string_split(text, ' ')) AS word_count2,
  len(list_distinct(string_split(lower(text), ' '))) AS num_unq_words, length(text) AS num_chars,
  round({AVERAGE_LENGTH.format(w='sw')}, 6) AS avg_word_length, {char_count(',')} AS comma_count, {char_count(';')} AS semicolon_count,
  round(len(st) / CAST(len(pt) AS DOUBLE), 6) AS length_ratio, {char_count('!')} AS exclamation_count, {char_count('?')} AS question_count,
  round(1.0 / len(list_distinct([{tag_case('t')} FOR t IN st])), 6) AS pos_mean, round({PUNCTUATION}, 6) AS punctuation_sum,
  round({DENSITY}, 6) AS keyword_density, round({JACCARD}, 6) AS jaccard_similarity,
  round(coalesce(sa.pol, 0.0), 6) AS sentiment_polarity, round(coalesce(sa.sub, 0.0), 6) AS sentiment_subjectivity,
  round(coalesce(cosine, 0.0), 6) AS text_similarity, round(ea.f, 6) AS gunning_fog,
  round(ea.k, 6) AS flesch_kincaid_grade_level, ea.c AS count_difficult_words,
  va.neg, va.neu, va.pos, va.compound, vp.neg_prompt, vp.neu_prompt, vp.pos_prompt, vp.compound_prompt
FROM pairs
JOIN ease ea ON ea.id = pairs.student_id
JOIN ease ep ON ep.id = 'p' || pairs.prompt_id
LEFT JOIN sums sa ON sa.id = pairs.student_id
LEFT JOIN cosines ON cosines.student_id = pairs.student_id
LEFT JOIN (SELECT id, {valence_columns()} FROM sums) va ON va.id = pairs.student_id
LEFT JOIN (SELECT id, {valence_columns('_prompt')} FROM sums) vp ON vp.id = 'p' || pairs.prompt_id"""


def rmse(where: str = "true") -> str:
    return f"sqrt(avg((y - pred) * (y - pred)) FILTER (WHERE {where}))"


BOTH_RMSE = f"""
  SELECT {rmse("target = 'content'")} AS content_rmse, {rmse("target = 'wording'")} AS wording_rmse"""
OWN = "m = fold + 1"

TRIALS = f"""{PREDS},
trials AS (SELECT CAST(trial AS INTEGER) AS trial, m, (((trial * 7 + m * 3) % 151) - 50) / 100.0 AS weight FROM range(70) t(trial), models),
blends AS (
  SELECT trial, target, row_id, sum(weight * pred) / sum(weight) AS pred, any_value(y) AS y
  FROM scored JOIN trials USING (m)
  WHERE trial IN (SELECT trial FROM trials GROUP BY trial HAVING abs(sum(weight)) >= 1e-9)
  GROUP BY trial, target, row_id),
results AS (
  SELECT trial, avg(e) AS mcrmse FROM (SELECT trial, target, {rmse()} AS e FROM blends GROUP BY trial, target) GROUP BY trial)"""

GROUPS = """SELECT 'documents.lang' AS key, lang AS grp, count(*) AS n FROM documents GROUP BY lang
  UNION ALL SELECT 'documents.source', source, count(*) FROM documents GROUP BY source
  UNION ALL SELECT 'conversations.conv_id', CAST(conv_id AS VARCHAR), count(*) FROM conversations GROUP BY conv_id
  UNION ALL SELECT 'orders.o_custkey', CAST(o_custkey AS VARCHAR), count(*) FROM orders GROUP BY o_custkey"""


def cleaning(text: str) -> str:
    for pattern, replacement in fv.CLEANING_STEPS:
        text = f"regexp_replace({text}, {literal(pattern)}, {literal(replacement)}, 'g')"
    return text


def grams(n: int) -> str:
    gram = " || ' ' || ".join(["t[i]"] + [f"t[i + {k}]" for k in range(1, n)])
    return f"[{gram} FOR i IN range(1, len(t) - {n - 2})]"


ORACLES: dict[str, str] = {
    "scan_prompts": f"WITH {TEXTS} SELECT * FROM prompts",
    "scan_summaries": f"WITH {TEXTS} SELECT student_id, prompt_id, text, content, wording FROM summaries LEFT JOIN truth USING (student_id)",
    "pred_table_scan": f"WITH {PREDS} SELECT row_id, model, target, pred FROM scored",
    "pred_table_sink": f"WITH {PREDS} SELECT row_id, model, target, pred FROM scored",
    "submission": f"""WITH {PREDS} SELECT CAST(row_id AS VARCHAR) AS student_id,
  round(avg(pred) FILTER (WHERE target = 'content'), 6) AS content,
  round(avg(pred) FILTER (WHERE target = 'wording'), 6) AS wording FROM scored GROUP BY row_id""",
    "sample_head": f"WITH {TEXTS} SELECT * FROM summaries ORDER BY student_id LIMIT 12",
    "peek": f"WITH {PREDS} SELECT row_id, model, target, pred FROM scored ORDER BY row_id, model, target LIMIT 5",
    "fold_split": greedy(
        "SELECT 'p' AS key, prompt_id AS grp, count(*) AS n FROM summaries GROUP BY prompt_id", TEXTS
    )
    + """ SELECT student_id, prompt_id, fold, CASE WHEN fold <> 0 THEN 'train' ELSE 'valid' END AS part
FROM summaries JOIN (SELECT grp, fold FROM r WHERE rn > 0) f ON f.grp = summaries.prompt_id""",
    "drop_non_features": f"WITH {PAIRS} SELECT {BASIC_COLUMNS} FROM pairs WHERE student_id IN (SELECT student_id FROM truth)",
    "drop_if_present": f"WITH {PAIRS} SELECT student_id, prompt_id, prompt_question, prompt_title FROM pairs",
    "model_input_text": f"WITH {PAIRS} SELECT student_id, prompt_title || '[SEP]' || prompt_question || '[SEP]' || text AS input FROM pairs",
    "truncate_tokens": f"WITH {PAIRS} SELECT student_id, len(st[1:512]) AS n_kept, st[least(len(st), 512)] AS last_token FROM pairs",
    "strip_model_prefix": f"WITH {PREDS} SELECT row_id, model, target, pred FROM scored",
    "model_subset": f"WITH {PREDS} SELECT row_id, model, target, pred FROM scored WHERE contains(model, 'clean_text')",
    "drop_pred_column": f"WITH {PREDS} SELECT row_id, model, target, pred FROM scored WHERE NOT (m = 1 AND target = 'content')",
    "join_prompt": f"WITH {PAIRS} SELECT student_id, prompt_id, prompt_title, prompt_question, length(prompt_text) AS prompt_chars FROM pairs",
    "concat_columns": f"""WITH {TEXTS}, src AS (SELECT student_id, text FROM summaries), counted AS ({readability_counts('text')})
SELECT student_id, CAST(s AS BIGINT) AS sentences, w AS words, CAST(y AS BIGINT) AS syllables, c AS long_words FROM counted""",
    "oof_scatter": f"WITH {PREDS} SELECT row_id, fold, target, pred FROM scored WHERE {OWN}",
    "oov_words": f"WITH {OOV} SELECT word FROM oov",
    "in_prompt_words": f"""WITH {PAIRS}, a AS (SELECT DISTINCT student_id, unnest(sw) AS word FROM pairs),
p AS (SELECT DISTINCT student_id, unnest(pw) AS word FROM pairs)
SELECT student_id, word FROM a SEMI JOIN p USING (student_id, word)""",
    "labels_preds_align": f"WITH {PREDS} SELECT row_id, target, model, pred, y FROM scored",
    "correction_candidates": f"WITH {NEAR1} SELECT word, candidate, freq FROM near1",
    "rmse": f"WITH {PREDS} SELECT round({rmse()}, 6) AS rmse FROM scored WHERE m = 1 AND target = 'content'",
    "mcrmse": f"""WITH {PREDS} SELECT round(content_rmse, 6) AS content_rmse, round(wording_rmse, 6) AS wording_rmse,
  round((content_rmse + wording_rmse) / 2, 6) AS mcrmse FROM ({BOTH_RMSE} FROM scored WHERE m = 1)""",
    "compt_score": f"WITH {PREDS} SELECT round((content_rmse + wording_rmse) / 2, 6) AS score FROM ({BOTH_RMSE} FROM scored WHERE m = 1)",
    "pooled_oof_rmse": f"WITH {PREDS} SELECT round((content_rmse + wording_rmse) / 2, 6) AS mcrmse FROM ({BOTH_RMSE} FROM scored WHERE {OWN})",
    "fold_rmse": f"WITH {PREDS} SELECT fold, target, round({rmse()}, 6) AS rmse FROM scored WHERE {OWN} GROUP BY fold, target",
    "model_leaderboard": f"""WITH {PREDS} SELECT model, round(avg(e), 6) AS mcrmse
FROM (SELECT model, target, {rmse()} AS e FROM scored GROUP BY model, target) GROUP BY model""",
    "fold_mean": f"""WITH {PREDS} SELECT row_id, target, round(avg(CASE WHEN (row_id + m) % 7 <> 0 THEN pred END), 6) AS pred
FROM scored WHERE m <= 4 GROUP BY row_id, target""",
    "uniform_blend": f"WITH {PREDS} SELECT row_id, target, round(avg(pred), 6) AS pred FROM scored GROUP BY row_id, target",
    "weighted_blend": f"""WITH {PREDS}, {FORMULA_WEIGHTS}
SELECT row_id, target, round(sum(weight * pred) / sum(weight), 6) AS pred FROM scored JOIN weights USING (model) GROUP BY row_id, target""",
    "inverse_rmse_weights": f"""WITH {PREDS} SELECT model, round(1.0 / avg(e), 6) AS weight
FROM (SELECT model, target, {rmse()} AS e FROM scored GROUP BY model, target) GROUP BY model""",
    "tag_histogram": f"""WITH {PAIRS}, tagged AS (SELECT student_id, len(st) AS total, unnest([{tag_case('t')} FOR t IN st]) AS tag FROM pairs)
SELECT student_id, tag, count(*) AS n, round(count(*) / CAST(any_value(total) AS DOUBLE), 6) AS share FROM tagged GROUP BY student_id, tag""",
    "char_histogram": f"""WITH {TEXTS}, marks AS (
  SELECT student_id, length(text) AS total, unnest(regexp_extract_all(text, '[.,!?;:"()\\[\\]{{}}]')) AS mark FROM summaries)
SELECT student_id, mark, round(count(*) / CAST(any_value(total) AS DOUBLE), 6) AS share FROM marks GROUP BY student_id, mark""",
    "group_kfold": greedy(GROUPS) + " SELECT key, grp, fold FROM r WHERE rn > 0",
    "distinct_count": f"WITH {PAIRS} SELECT student_id, len(list_distinct(sw)) AS distinct_words, len(list_distinct(st)) AS distinct_tokens FROM pairs",
    "word_overlap": f"""WITH {PAIRS} SELECT student_id, len(list_distinct([w FOR w IN list_intersect(st, pt) IF w IN ({STOP})])) AS stop_overlap,
  len(list_distinct([w FOR w IN list_intersect(st, pt) IF w NOT IN ({STOP})])) AS content_overlap FROM pairs""",
    "ngrams": f"""WITH {TEXTS}, made AS (
  SELECT student_id, {grams(2)} AS g2, {grams(3)} AS g3 FROM (SELECT student_id, regexp_extract_all(text, {TOKEN}) AS t FROM summaries))
SELECT student_id, len(g2) AS n_2grams, len(g3) AS n_3grams, len(list_distinct(g2)) AS distinct_2grams, len(list_distinct(g3)) AS distinct_3grams,
  md5(array_to_string(g2, '|')) AS digest_2grams, md5(array_to_string(g3, '|')) AS digest_3grams FROM made""",
    "ngram_overlap": f"WITH {PAIRS} SELECT student_id, {overlap(2)} AS bigram_overlap_count, {overlap(3)} AS trigram_overlap_count FROM pairs",
    "ngram_overlap_ratio": f"""WITH {PAIRS} SELECT student_id,
  round({overlap(2)} / CAST(nullif(len(st) - 1, 0) AS DOUBLE), 6) AS bigram_overlap_ratio,
  round({overlap(3)} / CAST(nullif(len(st) - 2, 0) AS DOUBLE), 6) AS trigram_overlap_ratio FROM pairs""",
    "jaccard": f"WITH {PAIRS} SELECT student_id, round({JACCARD}, 6) AS jaccard FROM pairs",
    "quotes_overlap": f"""WITH {PAIRS}, quoting AS (
  SELECT student_id, prompt_text, text || ' "' || substr(prompt_text, 1, 20) || '" "#" "' || substr(prompt_text, 1, 20) || '"' AS q FROM pairs)
SELECT student_id, len([x FOR x IN regexp_extract_all(q, {QUOTE}, 1) IF contains(prompt_text, x)]) AS quotes_count FROM quoting""",
    "entity_overlap": f"""WITH {PAIRS},
opened AS (SELECT regexp_extract_all(sentence, {TOKEN}) AS t FROM (SELECT unnest(string_split(lower(text), '.')) AS sentence FROM benchmark)),
gazetteer AS (
  SELECT t[1] AS phrase, 'PERSON' AS label FROM opened WHERE len(t) >= 1
  UNION SELECT t[1] || ' ' || t[2], 'ORG' FROM opened WHERE len(t) >= 2
  UNION SELECT t[1] || ' ' || t[2] || ' ' || t[3], 'GPE' FROM opened WHERE len(t) >= 3),
sides AS (
  SELECT student_id, 'a' AS side, regexp_extract_all(lower(text), {TOKEN}) AS t FROM pairs
  UNION ALL SELECT student_id, 'p', regexp_extract_all(lower(prompt_text), {TOKEN}) FROM pairs),
spelled AS (
  SELECT DISTINCT student_id, side, unnest(list_concat(t, {grams(2)}, {grams(3)})) AS phrase FROM sides),
named AS (SELECT student_id, side, phrase, label FROM spelled JOIN gazetteer USING (phrase)),
shared AS (
  SELECT student_id, phrase, label FROM named WHERE side = 'a'
  INTERSECT SELECT student_id, phrase, label FROM named WHERE side = 'p')
SELECT student_id, label, count(*) AS n_common FROM shared GROUP BY student_id, label""",
    "tokens": f"WITH {PAIRS} SELECT student_id, len(st) AS n_tokens, array_to_string(st, ' ') AS tokens FROM pairs",
    "token_length": f"WITH {PAIRS} SELECT student_id, len(st) AS summary_length FROM pairs",
    "ws_words": f"WITH {PAIRS} SELECT student_id, len(sw) AS word_count FROM pairs",
    "char_counts": per_answer(
        f"{char_count(',')} AS comma_count",
        f"{char_count(';')} AS semicolon_count",
        f"{char_count('!')} AS exclamation_count",
        f"{char_count('?')} AS question_count",
    ),
    "sentence_pieces": per_answer("len(string_split(text, '.')) AS sentence_length"),
    "space_pieces": per_answer("len(string_split(text, ' ')) AS word_count2"),
    "vocab_richness": f"WITH {PAIRS} SELECT student_id, len(list_distinct(sw)) AS vocabulary_richness FROM pairs",
    "num_unq_words": per_answer("len(list_distinct(string_split(lower(text), ' '))) AS num_unq_words"),
    "num_chars": per_answer("length(text) AS num_chars"),
    "avg_word_length": f"WITH {PAIRS} SELECT student_id, round({AVERAGE_LENGTH.format(w='sw')}, 6) AS avg_word_length FROM pairs",
    "punctuation_sum": per_answer(f"round({PUNCTUATION}, 6) AS punctuation_sum"),
    "sentences": f"""WITH {TEXTS}, src AS (SELECT student_id, text FROM summaries), counted AS ({readability_counts('text')})
SELECT student_id, CAST(s AS BIGINT) AS sentences FROM counted""",
    "syllables": f"""WITH {TEXTS}, src AS (SELECT student_id, text FROM summaries), counted AS ({readability_counts('text')})
SELECT student_id, CAST(y AS BIGINT) AS syllables FROM counted""",
    "difficult_words": f"""WITH {TEXTS}, src AS (SELECT student_id, text FROM summaries), counted AS ({readability_counts('text')})
SELECT student_id, c AS count_difficult_words,
  len([x FOR x IN words IF len(regexp_extract_all(x, '[aeiouyAEIOUY]+')) >= 4]) AS at_least_4 FROM counted""",
    "pos_mean": f"WITH {PAIRS} SELECT student_id, round(1.0 / nullif(len(list_distinct([{tag_case('t')} FOR t IN st])), 0), 6) AS pos_mean FROM pairs",
    "flesch_reading_ease": formula(EASE, "flesch_reading_ease"),
    "flesch_kincaid": formula(GRADE, "flesch_kincaid_grade_level"),
    "gunning_fog": formula(FOG, "gunning_fog"),
    "clean_text": f"SELECT page_id, {cleaning(chr(39).join(['url || ', ' ', ' || html']))} AS cleaned FROM pages",
    "length_ratio": f"WITH {PAIRS} SELECT student_id, round(len(st) / CAST(nullif(len(pt), 0) AS DOUBLE), 6) AS length_ratio FROM pairs",
    "keyword_density": f"WITH {PAIRS} SELECT student_id, round({DENSITY}, 6) AS keyword_density FROM pairs",
    "token_tags": f"WITH {PAIRS} SELECT student_id, array_to_string([{tag_case('t')} FOR t IN st], ' ') AS tags FROM pairs",
    "lexicon_polarity": f"""WITH {TEXTS}, {LEXICON}
SELECT student_id, round(coalesce(avg(polarity), 0.0), 6) AS polarity, round(coalesce(avg(subjectivity), 0.0), 6) AS subjectivity
FROM summaries LEFT JOIN found USING (student_id) GROUP BY student_id""",
    "valence_scores": f"""WITH {TEXTS}, {LEXICON}
SELECT student_id, {valence_columns()} FROM (
  SELECT student_id, {valence_sums()} FROM summaries LEFT JOIN found USING (student_id) GROUP BY student_id)""",
    "expand_struct": f"""WITH {TEXTS}, {SAMPLE}
SELECT prompt_id, {valence_columns('_prompt')} FROM (
  SELECT prompt_id, {valence_sums()} FROM prompts
  LEFT JOIN (SELECT prompt_id, word, valence FROM (SELECT prompt_id, unnest(regexp_extract_all(lower(prompt_text), {WORD})) AS word FROM prompts)
             LEFT JOIN sample USING (word)) USING (prompt_id) GROUP BY prompt_id)""",
    "tfidf_similarity": f"""WITH {PAIRS}, {TFIDF}
SELECT student_id, round(coalesce(cosine, 0.0), 6) AS text_similarity FROM summaries LEFT JOIN cosines USING (student_id)""",
    "augment_vocabulary": f"WITH {VOCABULARY} SELECT word, freq FROM vocab",
    "spelling_errors": f"""WITH {TEXTS}, {VOCABULARY},
checked AS (
  SELECT DISTINCT student_id, word FROM (SELECT student_id, unnest(regexp_extract_all(lower(text), {SPACED})) AS word FROM summaries)
  WHERE NOT regexp_full_match(word, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?')
    AND NOT regexp_full_match(word, '[!-/:-@\\[-`{{-~]')),
missing AS (SELECT student_id, count(*) AS n FROM checked WHERE word NOT IN (SELECT word FROM vocab) GROUP BY student_id)
SELECT student_id, coalesce(n, 0) AS spelling_errors FROM summaries LEFT JOIN missing USING (student_id)""",
    "autocorrect": f"""WITH {TEXTS}, {CORRECTIONS},
pieces AS (
  SELECT student_id, unnest(p) AS piece, generate_subscripts(p, 1) AS i
  FROM (SELECT student_id, regexp_extract_all(text, '{fv.WORD_PATTERN}|[^{fv.WORD_CHARS}]+') AS p FROM summaries)),
rewritten AS (
  SELECT student_id, string_agg(CASE WHEN correction IS NULL THEN piece
    WHEN regexp_full_match(substr(piece, 1, 1), '[A-Z]') THEN upper(substr(correction, 1, 1)) || substr(correction, 2)
    ELSE correction END, '' ORDER BY i) AS fixed
  FROM pieces LEFT JOIN corrections ON corrections.word = lower(piece) GROUP BY student_id)
SELECT student_id, coalesce(fixed, text) AS fixed_summary_text FROM summaries LEFT JOIN rewritten USING (student_id)""",
    "features_basic": f"WITH {PAIRS} SELECT student_id, {BASIC_COLUMNS} FROM pairs",
    "features_enriched": ENRICHED,
    "stack_features": f"""WITH {PAIRS}, {PREDS}, {FORMULA_WEIGHTS},
blended AS (SELECT row_id, target, sum(weight * pred) / sum(weight) AS pred FROM scored JOIN weights USING (model) GROUP BY row_id, target)
SELECT student_id, len(st) AS summary_length, len([q FOR q IN regexp_extract_all(text, {QUOTE}, 1) IF contains(prompt_text, q)]) AS quotes_count,
  round(c.pred, 6) AS content_pred, round(w.pred, 6) AS wording_pred
FROM pairs LEFT JOIN blended c ON CAST(c.row_id AS VARCHAR) = student_id AND c.target = 'content'
LEFT JOIN blended w ON CAST(w.row_id AS VARCHAR) = student_id AND w.target = 'wording'""",
    "weight_search": f"WITH {TRIALS} SELECT trial, round(mcrmse, 6) AS mcrmse FROM results",
    "best_trial": f"WITH {TRIALS} SELECT trial, round(mcrmse, 6) AS mcrmse FROM results ORDER BY round(mcrmse, 6), trial LIMIT 1",
    "run_report": f"""WITH {PREDS} SELECT round(content_rmse, 6) AS content_rmse, round(wording_rmse, 6) AS wording_rmse,
  round((content_rmse + wording_rmse) / 2, 6) AS mcrmse, {{settings}} FROM ({BOTH_RMSE} FROM scored WHERE {OWN})""",
    "expand_targets": f"""WITH {TEXTS} SELECT student_id, 'content' AS target, content AS y FROM truth
UNION ALL SELECT student_id, 'wording', wording FROM truth""",
    "score_partitions": """SELECT vec_id, round(list_sum([CAST(embedding[i + 1] AS DOUBLE) * (((i * 7) % 11 - 5) / 10.0) FOR i IN range(64)]), 6) AS pred
FROM embeddings""",
}

ORACLES["spelling_errors_stream"] = ORACLES["spelling_errors"]
ORACLES["score_models"] = f"""WITH {PAIRS},
models AS (SELECT * FROM (VALUES ('short', 8, 0.5::DOUBLE), ('middle', 64, 1.0::DOUBLE), ('whole', 1000000000, 2.0::DOUBLE)) v(model, most, factor))
SELECT student_id, model, round(factor * coalesce(list_avg([CAST(length(t) AS DOUBLE) FOR t IN st[1:most]]), 0.0), 6) AS pred FROM pairs, models"""
ORACLES["features_lexicon_table"] = ENRICHED.replace(f"{SAMPLE},", f"{LEXICON}, sample AS (SELECT * FROM lexicon),")
ORACLES["syllables_irregular"] = f"""WITH {TEXTS}, {LEXICON},
irregular AS (SELECT word, length(word) % 4 + 1 AS syllables FROM lexicon WHERE length(word) % 3 = 0),
each AS (
  SELECT student_id, coalesce(syllables, greatest(1, len(regexp_extract_all(word, '[aeiouy]+')))) AS s
  FROM (SELECT student_id, unnest(regexp_extract_all(lower(text), {WORD})) AS word FROM summaries) LEFT JOIN irregular USING (word))
SELECT student_id, CAST(coalesce(sum(s), 0) AS BIGINT) AS syllables, CAST(count(CASE WHEN s >= {fv.COMPLEX_WORD_SYLLABLES} THEN 1 END) AS BIGINT) AS long_words
FROM summaries LEFT JOIN each USING (student_id) GROUP BY student_id"""

ORACLES["feature_build"] = f"""
SELECT e.*, s.spelling_errors AS splling_err_num, a.fixed_summary_text, t.prompt_id, t.text, t.content, t.wording
FROM ({ORACLES['features_enriched']}) e
JOIN ({ORACLES['spelling_errors']}) s USING (student_id)
JOIN ({ORACLES['autocorrect']}) a USING (student_id)
JOIN (WITH {TEXTS} SELECT student_id, prompt_id, text, content, wording FROM summaries JOIN truth USING (student_id)) t USING (student_id)"""


def _settings() -> str:
    from dataclasses import asdict

    from ..config import RunConfig

    def value(v) -> str:
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, str):
            return literal(v)
        return f"CAST({v} AS {'DOUBLE' if isinstance(v, float) else 'INTEGER'})"

    return ", ".join(f"{value(v)} AS {k}" for k, v in sorted(asdict(RunConfig()).items()))


ORACLES["run_report"] = ORACLES["run_report"].replace("{settings}", _settings())

for _name in ("features_basic", "features_enriched"):
    ORACLES[_name] = f"""SELECT f.*, s.spelling_errors AS splling_err_num
FROM ({ORACLES[_name]}) f JOIN ({ORACLES['spelling_errors']}) s USING (student_id)"""

FOLDED = (
    greedy(
        "SELECT 'p' AS key, prompt_id AS grp, count(*) AS n FROM summaries JOIN truth USING (student_id) GROUP BY prompt_id", TEXTS
    )
    + """, folded AS (
  SELECT student_id, fold, content, wording FROM summaries JOIN truth USING (student_id) JOIN (SELECT grp, fold FROM r WHERE rn > 0) f ON f.grp = prompt_id),
longer AS (SELECT student_id, 'content' AS target, fold, content AS y FROM folded UNION ALL SELECT student_id, 'wording', fold, wording FROM folded)"""
)
HELD_OUT = f"{FOLDED} SELECT student_id, target, fold, y, true AS is_number, true AS varied, true AS learnt"
ORACLES["stage1_oof"] = f"{HELD_OUT} FROM longer"
ORACLES["gbt_oof"] = f"{HELD_OUT}, true AS beats_means FROM longer"
ORACLES |= {
    name: f"""WITH {TEXTS} SELECT student_id, true AS content_is_number, true AS wording_is_number
FROM summaries WHERE student_id NOT IN (SELECT student_id FROM truth)"""
    for name in ("stage1_test", "gbt_test_mean", "full_run")
}
EACH_MODEL = "(SELECT DISTINCT target, fold FROM longer)"
ORACLES |= {
    "gbt_cv": f"{FOLDED} SELECT target, fold, true AS best_round_kept, true AS stopped_by_patience FROM {EACH_MODEL}",
    "eval_history": f"{FOLDED} SELECT target, fold, true AS gapless, true AS all_numbers FROM {EACH_MODEL}",
    "best_checkpoint": f"{FOLDED} SELECT target, fold, true AS kept FROM {EACH_MODEL}",
    "model_store": f"{FOLDED} SELECT student_id, target, true AS same FROM longer",
}
ORACLES["gbt_nested"] = f"""{FOLDED} SELECT target, fold, count(*) AS held_rows,
  CAST(sum(count(*)) OVER (PARTITION BY target) - count(*) AS BIGINT) AS learnt_rows, true AS groups_apart, true AS rounds_chosen,
  true AS not_below_own_stop, true AS recomputed FROM longer GROUP BY target, fold"""
ORACLES["weight_search_stacked"] = f"""WITH {TRIALS} SELECT trial, round(mcrmse, 6) AS blend_mcrmse,
  true AS scored, true AS never_worse, true AS left_as_worse, true AS every_rung FROM results"""
ORACLES["param_sweep"] = """SELECT CAST(trial AS INTEGER) AS trial, value, true AS scored
FROM (VALUES (0, 0.01::DOUBLE), (1, 0.03::DOUBLE), (2, 0.1::DOUBLE), (3, 0.3::DOUBLE), (4, 1.0::DOUBLE)) t(trial, value)"""
ORACLES["sampled_trials"] = """SELECT CAST(t AS INTEGER) AS trial, model,
  round(-0.5 + 0.01 * floor(('0x' || substr(md5('42:' || t || ':' || model), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE * 151), 6) AS weight
FROM range(500) r(t), (SELECT 'model_' || lpad(m::VARCHAR, 2, '0') AS model FROM range(1, 18) s(m))"""
ORACLES["runs_table"] = f"""SELECT run_name, content_rmse, wording_rmse, mcrmse, patience FROM ({ORACLES['run_report']})
UNION ALL SELECT 'again', content_rmse, wording_rmse, mcrmse, patience FROM ({ORACLES['run_report']})"""
ORACLES["feature_cache"] = f"""{FOLDED} SELECT f.*, folded.fold, true AS found_again
FROM ({ORACLES['feature_build']}) f JOIN folded ON folded.student_id = f.student_id"""
ORACLES["blend_run"] = f"SELECT *, true AS not_worse, true AS as_searched, CAST(4 AS BIGINT) AS runs_kept FROM ({ORACLES['full_run']})"


def cleaned(sql: str) -> str:
    """The statement over cleaned answers; the dictionary is counted in the texts as they are."""
    plain, unknown = "AS prompt_id, text\n  FROM documents)", f"SELECT unnest(regexp_extract_all(lower(text), {WORD})) AS word FROM documents)\n  WHERE"
    for part in (plain, unknown):
        if part not in sql:
            raise ValueError(f"not in the statement: {part}")
    return sql.replace(plain, f"AS prompt_id, {cleaning('text')} AS text\n  FROM documents)").replace(unknown, unknown.replace("lower(text)", f"lower({cleaning('text')})"))


ORACLES["feature_build_clean_all"] = cleaned(ORACLES["feature_build"])
ORACLES["feature_build_clean_fixed"] = ORACLES["feature_build"].replace(ORACLES["autocorrect"], cleaned(ORACLES["autocorrect"]))
