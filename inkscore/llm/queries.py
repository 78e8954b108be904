"""The thin queries of the operators, over whole tables, and their SQL counterparts where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkscore.llm import chat_windows, collocations, harmonic, structure_repair
from inkscore.llm.cross_polytope import nearest
from inkscore.llm.decontamination import contamination
from inkscore.llm.ngram_join import similar_components
from inkscore.llm.packing import pack_documents
from inkscore.llm.paragraph_dedup import without_repeats
from inkscore.llm.quality_mil import quality
from inkscore.llm.token_counts import count_tokens
from inkscore.llm.toxicity import toxicity
from inkscore.llm.warc import archived


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated paragraphs and passages, and where the kept ones stand."""
    removed = F.coalesce("removed", F.array().cast("array<struct<paragraph:int,kept_doc_id:bigint,kept_place:int>>"))
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_paragraphs",
        F.size(removed).alias("n_removed"),
        F.array_distinct(F.transform(removed, lambda r: r["kept_doc_id"])).alias("kept_doc_ids"),
        removed.alias("removed"),
        "n_cut",
        "text",
    )


def op2_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one made of control strings, read back from its windows."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = F.lit("<|im_end|><|im_start|>assistant ok").alias("text")
    row = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text)
    return chat_windows.read_back(chat_windows.windows(turns.unionByName(row)))


def op4_attention_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole document."""
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_cross_polytope_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth one."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back from their chunks."""
    return archived(table(spark, sf_dir, "pages"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words inside windows of ten words of any benchmark item."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole document."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 80 % of their five-word shingles."""
    return similar_components(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 1024 ids."""
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    return structure_repair.repair_damaged(table(spark, sf_dir, "conversations"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best phrases of each language."""
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in sequences of at most 2048 ids without padding."""
    return harmonic.pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_paragraph_dedup,
        op2_counterfactual_toxicity,
        op3_chat_windows,
        op4_attention_mil_quality,
        op5_cross_polytope_neighbours,
        op6_warc_chunks,
        op7_benchmark_decontamination,
        op8_token_counts,
        op9_ngram_jaccard_join,
        op10_best_fit_packing,
        op11_structure_repair,
        op12_phrase_collocations,
        op13_harmonic_packing,
    )
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _struct(cost: str, edits: str, lines: str) -> str:
    return f"{{'c': {cost}, 'x': {edits}, 't': {lines}}}"


def _edit(path: str, letter: str, cost: str, line: str | None = None) -> str:
    """SQL of a path (cost, edits, lines) after one more edit; null if the path is."""
    lines = f"{path}.t" if line is None else f"{path}.t || CASE WHEN {path}.t = '' THEN '' ELSE chr(10) END || {line}"
    return f"CASE WHEN {path} IS NOT NULL THEN {_struct(f'{path}.c + {cost}', f"{path}.x || '{letter}'", lines)} END"


def _repair_sql() -> str:
    """The least (cost, edits) into each state, row by row; texts in lines go along."""

    def stays(path: str, initial: str, role: str) -> list[str]:
        keep = _edit(path, "K", "e", "role || ':' || text")
        rerole = _edit(path, "R", "3 + e", f"'{role}:' || text")
        return [f"CASE WHEN free AND ini = '{initial}' THEN {keep} END", f"CASE WHEN free THEN {rerole} END"]

    def least(paths: list[str]) -> str:
        return f"list_min([{', '.join(paths)}])"

    n, s, u, a = (_edit(f"b.{x}", "D", "4") for x in "nsua")
    new = {
        "n": n,
        "s": least([s, stays("b.n", "s", "")[0]]),
        "u": least([u, *stays("b.n", "u", "user"), *stays("b.s", "u", "user"), *stays("b.a", "u", "user")]),
        "a": least([a, *stays("b.u", "a", "assistant")]),
    }
    into_user = least(["u", *(_edit(x, "I", "3", "'user:'") for x in "nsa")])
    into_assistant = least(["a", _edit("u", "I", "3", "'assistant:'")])
    start = _struct("0", "''", "''"), _struct("3", "'I'", "'user:'"), _struct("6", "'II'", "'user:' || chr(10) || 'assistant:'")
    return rf"""
        WITH RECURSIVE bits(k, i, v) AS (
          SELECT range, 0, range FROM range(256)
          UNION ALL SELECT k, i + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE i < 8),
        crc AS (SELECT list(v ORDER BY k) AS tab FROM bits WHERE i = 8),
        whole AS (
          SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(
              list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT)),
              lambda x, y: xor(x // 256, tab[xor(x % 256, y) + 1])), 4294967295) % 20 AS f
          FROM conversations, crc),
        damaged AS (
          SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                 CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
          FROM whole, range(2) WHERE f <> 0 AND (range = 0 OR f = 3)),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS place FROM damaged),
        found AS (
          SELECT *, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY place) AS before,
                 row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS seen,
                 regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) AS last FROM placed),
        rows AS (
          SELECT *, last = '' AS blank, last <> '' AND seen AS duplicate, last NOT IN ('', '.', '!', '?') AND NOT seen AS truncated,
                 last <> '' AND NOT seen AS free, CASE WHEN last NOT IN ('', '.', '!', '?') THEN 3 ELSE 0 END AS e FROM found),
        paths(conv_id, place, n, s, u, a) AS (
          SELECT DISTINCT conv_id, 0::BIGINT, {start[0]}, CASE WHEN false THEN {start[0]} END, {start[1]}, {start[2]} FROM placed
          UNION ALL
          SELECT conv_id, place, n, s, u, {into_assistant}
          FROM (SELECT conv_id, place, n, s, a, {into_user} AS u
                FROM (SELECT b.conv_id, r.place, {", ".join(f"{v} AS {k}" for k, v in new.items())}
                      FROM paths b JOIN rows r ON r.conv_id IS NOT DISTINCT FROM b.conv_id AND r.place = b.place + 1))),
        ends AS (
          SELECT conv_id, list_min([n, a]) AS best FROM paths QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY place DESC) = 1),
        counts AS (
          SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
                 count(*) FILTER (duplicate) AS duplicate, count(*) FILTER (truncated) AS truncated,
                 count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
          FROM rows GROUP BY conv_id)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
               coalesce(best.x, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o
        LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
    """


ORACLES = {
    "op6_warc_chunks": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        q AS (SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest,
                     CASE WHEN strlen(body) >= 100 THEN min(page_id) OVER (PARTITION BY sha256(body)) ELSE page_id END AS first
              FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to
        FROM q
    """,
    "op7_benchmark_decontamination": rf"""
        WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        s AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM b WHERE len(w) > 0),
        win AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 9], ' ') AS g, least(10, len(w)) AS n FROM s),
        sizes AS (SELECT DISTINCT n FROM win),
        places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n),
        hits AS (SELECT p.doc_id, p.k, p.n, win.item_id FROM places p JOIN win ON win.n = p.n AND win.g = array_to_string(p.w[p.k:p.k + p.n - 1], ' ')),
        covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM hits) GROUP BY doc_id),
        named AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items
                  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
    """,
    "op9_ngram_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[k:k + 4], ' ') END AS s
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
        pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM pairs JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(min(reach.b), d.doc_id) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, n.n
    """,
    "op11_structure_repair": _repair_sql(),
    "op12_phrase_collocations": rf"""
        WITH p AS (
          SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
          FROM (SELECT lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
        totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
        known AS (
          SELECT lang, phrase, words, count(*) AS f
          FROM (SELECT lang, s AS words, unnest([array_to_string(w[k:k + s - 1], ' ') FOR k IN range(1, len(w) - s + 2)]) AS phrase
                FROM p, (SELECT unnest([1, 2, 3, 4]) AS s))
          GROUP BY ALL HAVING count(*) >= 30),
        cuts AS (SELECT lang, phrase, words, f, string_split(phrase, ' ') AS w, unnest(range(1, words)) AS k FROM known WHERE words > 1),
        parts AS (
          SELECT c.lang, c.phrase, c.f, c.k, x.f AS l, y.f AS r, ((2000000 * c.f::HUGEINT) // (x.f + y.f)::HUGEINT)::BIGINT AS score
          FROM cuts c JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
          JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')),
        worst AS (SELECT * FROM parts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        inner_phrases AS (
          SELECT lang, array_to_string(string_split(phrase, ' ')[i:j], ' ') AS phrase, max(f) AS longer
          FROM (SELECT *, unnest(range(1, words + 1)) AS i FROM known WHERE words > 2), (SELECT unnest([2, 3, 4]) AS j)
          WHERE j > i AND j <= words AND j - i + 1 < words GROUP BY ALL),
        listed AS (
          SELECT worst.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, phrase) AS rank
          FROM worst LEFT JOIN inner_phrases USING (lang, phrase) WHERE longer IS NULL OR NOT 100 * longer::HUGEINT >= 80 * f::HUGEINT)
        SELECT lang, rank::BIGINT AS rank, phrase, f::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score
        FROM listed JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
